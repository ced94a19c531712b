"""Readers and writers: tables, dump files, pages, word lists, JSON, index directories."""
