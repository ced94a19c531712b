"""Template residue: unfilled places, never-filled values, filler, error pages and demands for scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivora.functions.ascii_terms import slices

KINDS = ("placeholder", "unfilled_value", "filler", "error_page", "script_notice")

_NAME = r"[^\W\d_][\w .\-]*+"
#: One grammar per pair of delimiters. A name may be of any length but holds no delimiter, so every text is read in time linear in its length.
PLACEHOLDERS = tuple(
    re.compile(p)
    for p in (
        r"\{\{\{\s*+" + _NAME + r"(?:\|[^{}\n]*+)?\}\}\}",
        r"(?<!\{)\{\{\s*+" + _NAME + r"(?:\|[^{}\n]*+)?\}\}(?!\})",
        r"<%[=\-]?\s*+[^\W\d_](?:[\w .]|-(?!%>))*+-?%>",
        r"\{%\s*+" + _NAME + r"%\}",
        r"[#$]\{\s*+" + _NAME + r"\}",
        r"(?<![\w{$#%])\{[^\W\d_]\w\w++\}(?!\})",
        r"(?<![\w$])\$[^\W\d_]\w\w++\$(?![\w$])",
        r"(?<![\w%])%[^\W\d_]\w\w++%(?![\w%])",
        r"<<\s*+" + _NAME + r">>",
        r"(?<!\w)__[^\W\d_](?:_?[^\W_]| )++__(?!\w)",
        r"@@\s*+" + _NAME + r"@@",
        r"(?<![\w:])::\s*+" + _NAME + r"::(?![\w:])",
        r"\[(?i:insert|your|enter|add|type|fill in|wstaw|wpisz|dodaj|podaj|twoj[ea]|ihre?|insérer|insérez|entrez|votre|insertar|inserte|escriba|su|inserisci|inserire|scrivi|il tuo|la tua) [^\[\]\n]*+\]",
        r"\[[^\W\d_](?:[\w .\-](?! (?:HERE|here|GOES|goes|einfügen|EINFÜGEN|eintragen|tutaj|ici|aquí|qui)\]| (?:GOES HERE|goes here)\]))*+[\w .\-] (?:HERE|here|GOES HERE|goes here|einfügen|EINFÜGEN|eintragen|tutaj|ici|aquí|qui)\]",
        r"\([^\W\d_](?:[\w .\-](?! (?:GOES HERE|goes here|HERE)\)))*+[\w .\-] (?:goes here|GOES HERE|HERE)\)",
    )
)
_DUNDER = PLACEHOLDERS[9].pattern
_OPENERS = ("{{{", "{{", "<%", "{%", "{", "{", "$", "%", "<<", "__", "@@", "::", "[", "[", "(")
_VALUE = r"(?:undefined|null|NULL|None|nil|NaN|nan|N/A|n/a|TBD|TBA|TODO|X{3,}|x{3,}|\?{3,}|%[sdif]|\{\d\}|\$\d|#(?:REF|VALUE|NAME|NULL|NUM|DIV/0|N/A)[!?]?|\[object Object\])"
#: A label with a value that was never filled, and a sentence whose subject and object were not.
UNFILLED = (
    re.compile(r"(?:^|[;.\n>|])[ \t]*+[^\W\d_][\w ]*+:[ \t]*+" + _VALUE + r"(?=[ \t]*+(?:[;.,\n|]|$))"),
    re.compile(r"(?<!\S)(" + _VALUE + r") [^\W\d_]\w*+ \1(?=[.;,\n]|$)"),
)
#: Words of the usual pseudo-Latin filler.
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)


def _words(*of: str) -> str:
    return r"\b(?:" + "|".join(x for line in of for x in line.split("  ")) + r")\b"


# Filler sentences stand in for a text. They are told by a part of a text that is named a sample, is still to come or belongs in a place, or by
# an instruction to put it there.

#: Parts of a text.
TOPIC = _words(
    "texts?  body  contents?  description  summary  article  copy  paragraph  section  block  title  entry  page  introduction  intro  something",
    r"treś\w*  tekst\w*  opis(?:u|em|y)?  artykuł\w*  akapit\w*  streszczeni\w*  hasł\w*  tytuł\w*  wstęp\w*",
    r"inhalt\w*  artikels?  beschreibung  absatz\w*  zusammenfassung  einleitung  abschnitt\w*  titel",
    "contenus?  texte  résumé  paragraphe  article  description  introduction  titre",
    "contenido  texto  artículo  descripción  resumen  párrafo  introducción  título",
    "contenuto  testo  articolo  descrizione  riassunto  paragrafo  introduzione  titolo",
)
#: That it is none yet.
FAKE = _words(
    "sample  example  dummy  placeholder  filler",
    r"przykładow\w+  zastępcz\w+  próbn\w+",
    r"blind\w*  muster\w*  beispiel\w*  platzhalter\w*  füll\w*",
    "d['’]exemple  de remplissage  fictif  factice  provisoire  de substitution",
    "de ejemplo  de muestra  de relleno  de prueba  provisional  ficticio",
    "di esempio  segnaposto  di prova  provvisorio  fittizio  finto",
)
_COMPOUND = r"\b(?:blind|muster|beispiel|platzhalter|füll)text\w*"
#: Where it belongs, and that it does.
PLACE = _words(
    "here  below  above  in this (?:place|box|field|section|space)",
    "tu  tutaj  w tym (?:miejscu|polu)",
    "hier  an dieser stelle  in diese[ms]? (?:feld|stelle)",
    "ici  à cet endroit  dans ce champ",
    "aquí  en este (?:lugar|campo)",
    "qui  in questo (?:punto|campo|spazio)",
)
GOES = _words("goes  go  comes  belongs?  your", r"trafi  będzie  tw[oó]j\w*", "gehört  kommt  ihre?", "va  votre  vient", "va  irá  su", "va  andrà  il tuo  la tua")
#: That it is to come.
FUTURE = _words(
    "will be  later  to be (?:added|written|filled|replaced)  coming soon  is coming  soon  to follow  follows soon  under construction  in preparation",
    "wkrótce  później  zostanie  do (?:uzupełnienia|napisania|wpisania|zastąpienia)  w przygotowaniu",
    "folgt  bald  später  kommt noch  in kürze  zu (?:ersetzen|schreiben|ergänzen)  in vorbereitung",
    "bientôt  plus tard  à venir  à (?:remplacer|écrire|compléter|rédiger)  en préparation",
    "próximamente  pronto  más tarde  pendiente  por (?:escribir|completar)  para (?:sustituir|reemplazar)  en preparación",
    "in arrivo  presto  più tardi  da (?:scrivere|inserire|completare|sostituire)  in preparazione",
)
#: Instructions with which a sentence begins.
EDIT = (
    r"(?:enter|type|write|paste|insert|add|put|place|replace|edit|click|tap|press|double-click|wpisz|wklej|wstaw|kliknij|stuknij|dotknij|naciśnij|zastąp"
    r"|(?:klicken|tippen|doppelklicken|schreiben|geben|fügen|ersetzen) sie|cliquez|touchez|appuyez|double-cliquez|saisissez|écrivez|collez|insérez|remplacez"
    r"|haga (?:doble )?clic|pulse|toque|escriba|introduzca|pegue|inserte|sustituya|(?:fai|fare) (?:doppio )?clic|clicca|tocca|inserisci|incolla|scrivi|sostituisci)\b"
)
_EDIT_FIRST = rf"^\W*(?:{PLACE}\W+)?" + EDIT
_EDITING = r"\bto (?:edit|change|modify|add)\b|\b(?:edytować|zmienić|dodać|bearbeiten|ändern|modifier|éditer|changer|editar|cambiar|modificar|modificare|cambiare|modifica)\b"
_STANDING = {name: re.compile(p, re.I) for name, p in (("topic", TOPIC), ("fake", FAKE), ("place", PLACE), ("goes", GOES), ("future", FUTURE), ("edit", _EDIT_FIRST), ("editing", _EDITING), ("compound", _COMPOUND), ("ends", PLACE + r"\W*$"), ("small", r"\b(?:the|of|an?|this|le|la|les|l|de|du|des|el|los|las|il|lo|i|gli|del|della|der|die|das|dem|ten|ta|to|tego)\b"))}
#: What a paragraph with such a sentence holds.
FILLER = re.compile("|".join((_COMPOUND, _EDITING, rf"(?:{FAKE}|{FUTURE}|{EDIT}|{PLACE})[^.!?\n]*{TOPIC}", rf"{TOPIC}[^.!?\n]*(?:{FAKE}|{FUTURE}|{PLACE})")), re.I)

# A message is told by what its sentences are about, not by their wording: some part of a system, a failure of it, the reader who is
# addressed, an instruction, a status. Word classes for English, Polish, German, French, Spanish and Italian, two blanks between words.

#: What a message speaks of.
SYSTEM = _words(
    "pages?  wiki  viewer  (?:web ?)?sites?  servers?  services?  hosts?  connections?  network  requests?  sessions?  databases?  applications?  app  browsers?  accounts?  login  content  resources?  files?  links?  url  address  domain  entry  article  query  backend  upstream  proxy  clients?  traffic  access  permissions?  errors?  limit",
    r"stron\w*  serwis\w*  serwer\w*  portal\w*  usług\w*  połączeni\w*  żądani\w*  sesj\w*  bazy?  aplikacj\w*  przeglądark\w*  kont[oa]  zas[oó]b\w*  treś\w*  plik\w*  adres\w*  hasł\w*  błęd\w*  błąd  dostęp\w*  uprawnie\w*",
    r"(?:web)?seiten?  servers?  dienst\w*  (?:datenbank|server|netz)?verbindung\w*  anfragen?  sitzung  datenbank\w*  anwendung  konto  inhalte?s?  dateie?n?  adresse  artikels?  blatt  fehlers?  zugriffs?  zugang  berechtigung\w*  recht\w*",
    r"serveurs?  connexion  réseau  requêtes?  base de données  application  navigateur  compte  contenus?  fichiers?  adresse  ressources?  erreurs?  accès  droits?",
    r"páginas?  sitio  servidor\w*  servicios?  conexión  red  solicitud\w*  petici\w+  sesión  base de datos  aplicación  navegador  cuenta  contenidos?  archivos?  dirección  recursos?  artículos?  acceso  permisos?",
    r"pagin[ae]  sito  servizio  connessione  rete  richiest[ae]  sessione  applicazione  contenut[oi]  indirizzo  risors[ae]  voce  articol[oi]  errori?e?  accesso  permess[oi]",
)
#: What befalls it.
FAILURE = _words(
    r"not(?: be)? (?:found|available|exist|allowed|permitted|authori[sz]ed|reachable|responding|responded|load(?:ed)?|display(?:ed)?|shown|process(?:ed)?|complete[d]?|reach(?:ed)?|open(?:ed)?|have  here)  n['o’]t (?:found|available|exist|load|display|show|open|reach|process|have)  cannot  can['’]t  can not  could(?: not|n['’]t)  unable  unavailable  unreachable  no longer  no such  nothing  fail(?:ed|ure|s)  denied  forbidden  refused  rejected  expired  timed out  time-?out  (?:been|is|are|was|were|connection|session) (?:lost|moved|deleted|removed|blocked|suspended|disabled|interrupted|closed)  (?:limit|quota) (?:reached|exceeded)  interrupted  aborted  reset  closed (?:early|unexpectedly|by)  no (?:reply|response|answer)  down  offline  read-only  maintenance  overload(?:ed)?  unexpected  internal  wrong  problems?  difficult(?:y|ies)  exceeded  too many  unusual  temporarily  invalid  missing  broken  unauthori[sz]ed  insufficient  crashed",
    r"nie (?:znaleziono|istnieje|można|działa|ma|masz|udało|odpowiada|jest dostępn\w*)  niedostępn\w*  nieczynn\w*  nieoczekiwan\w*  wewnętrzn\w*  brak\w*  odmow\w*  odrzucon\w*  wygas\w*  przerwan\w*  utracon\w*  zablokowan\w*  usunięt\w*  przeniesion\w*  przeciąż\w*  prac(?:e|ach)? technicznych?  awari\w*  problem\w*  zbyt wiele  przekroczon\w*  niewystarczając\w*",
    r"nicht (?:gefunden|verfügbar|erreichbar|erlaubt|gestattet|geladen|möglich|mehr|angezeigt)  existiert nicht  gibt es nicht\w*  unerwartet\w*  intern\w*  verweigert  abgelehnt  abgelaufen  unterbrochen  verloren  gesperrt  gelöscht  entfernt  verschoben  wartung\w*  überlast\w*  störung\w*  problem\w*  zu viele  überschritten  unzureichend\w*  fehlgeschlagen  außer betrieb",
    r"introuvables?  indisponibles?  inaccessible  n['’]existe (?:pas|plus)  n['’]est (?:pas|plus)  ne (?:peut|répond)  impossible  rien  refusée?  interdite?  expirée?  interrompue?  perdue?  bloquée?  supprimée?  déplacée?  maintenance  surcharge  inattendue?  interne  pannes?  problèmes?  trop de  dépassée?  insuffisants?e?s?  échou\w+  échec",
    r"no (?:encontrad[oa]|se encontró|existe|disponible|está|se puede|se pudo|responde|autorizad[oa]|tiene)  no se ha  inesperad[oa]  interno  nada  denegad[oa]  prohibid[oa]  rechazad[oa]  caducad[oa]  interrumpid[oa]  perdid[oa]  bloquead[oa]  eliminad[oa]  movid[oa]  mantenimiento  sobrecarga\w*  problemas?  demasiad[oa]s  superad[oa]  insuficientes?  fall[óo]  fallid[oa]  imposible",
    r"non (?:trovat[oa]|esiste|disponibile|è|raggiungibile|risponde|autorizzat[oa]|si può|hai|consentit[oa])  imprevist[oa]  intern[oa]  niente  nulla  negat[oa]  vietat[oa]  rifiutat[oa]  scadut[oa]  interrott[oa]  pers[oa]  bloccat[oa]  eliminat[oa]  rimoss[oa]  spostat[oa]  manutenzione  sovraccaric\w+  guast[oi]  problem[ai]  tropp[ei]  superat[oa]  insufficienti?e?  fallit[oa]  impossibile",
)
#: The reader, or the moment.
ADDRESS = _words(
    r"you  your  please  kindly  sorry  we  our  this (?:page|site|website|content|app|application|service|article|link|feature)  to (?:continue|view|proceed|see|load)  this \w+(?= (?:needs|requires|relies|cannot|depends))  currently  right now  at the moment  later  again  requested  wanted",
    r"proszę  prosimy  przepraszamy  twoj\w+  t[aeęy]j? (?:stron\w*|aplikacj\w*|treś\w*)  aby  ponownie  później  chwilowo  tymczasowo  obecnie",
    r"bitte  sie  ihre?[nmrs]?  diese[rsn]? (?:seite|anwendung|inhalt|dienst|website|webseite)  derzeit  erneut  später  vorübergehend  leider  wir",
    r"veuillez  vous  votre  cette (?:page|application)  ce (?:site|contenu|service)  désolés?  nous  ultérieurement  actuellement  momentanément  temporairement  pour (?:continuer|afficher|voir)",
    r"por favor  usted  su (?:navegador|cuenta|sesión)  esta (?:página|aplicación)  este (?:sitio|contenido|servicio)  lo sentimos  inténtelo  más tarde  actualmente  temporalmente  para (?:continuar|ver)",
    r"per favore  questa (?:pagina|applicazione)  questo (?:sito|contenuto|servizio)  tuo  spiacenti  siamo  riprova  più tardi  momentaneamente  al momento  per (?:continuare|visualizzare|vedere)",
)
#: Instructions with which a sentence begins.
ACTION = (
    r"^\W*(?:(?:you must|bitte|please|por favor|per favore|prosimy|proszę)\s+)?(?:go back|return to|try|retry|wait|reload|refresh|come back|check (?:your|that|the)|checking (?:your|that|if)|contact|log in|sign in|slow down|search instead"
    r"|spróbuj|odśwież|wróć|zaloguj|poczekaj|zaczekaj|sprawdź|versuchen|laden sie|melden sie|zuerst anmelden|anmelden|kehren|warten|prüfen|réessayez|veuillez|rechargez|revenez|connectez|patientez|vérifiez"
    r"|inténtelo|vuelva|intente|recargue|inicie sesión|espere|compruebe|regrese|riprova|torna|ricarica|accedi|attendi|controlla|effettua)\b"
)
#: What needs no company: a status with its phrase, the marks of a program that broke off, and the idioms of failure.
STATUS = (
    r"\b(?:error|status|http|code|błąd|fehler|erreur|errore)\W{1,3}(?:\w+\W{1,3})?[45]\d\d\b|\b[45]\d\d\W{1,4}(?:not found|forbidden|gone|bad gateway|bad request|gateway time-?out|internal server error|service unavailable|too many requests|unauthorized|request time-?out)"
    r"|traceback \(|(?:uncaught|unhandled) \w+|fatal error|parse error|syntax error|\b\w+(?:error|exception): |\b(?:warning|failed|aborted|exception): |\bon line \d+|segmentation fault|stack trace|core dumped"
    r"|\b(?:unexpected|internal|unknown) (?:server )?error\b|nieoczekiwany błąd|wewnętrzny błąd|błąd (?:wewnętrzny|nieoczekiwany|serwera)|(?:unerwarteter|interner) fehler|erreur (?:interne|inattendue)|error (?:interno|inesperado)|errore (?:interno|imprevisto)"
    r"|(?:something|things) (?:has |have )?(?:went|gone) wrong|poszło nie tak|schief ?ge(?:laufen|gangen)|(?:mal passé|mal tourné)|passé quelque chose|salió mal|andato storto"
    r"|(?:error|problem|błąd|fehler|störung|erreur|panne|problème|errore|problema|guasto|fallo|awaria)\b(?:\W+\w+)?\W+(?:occurred|aufgetreten|survenue?|verificat[oa])|(?:wystąpi[łl][ao]?|se (?:ha producido|produjo)) (?:\w+ )?(?:błąd|awaria|problem|error|fallo|problema)"
    r"|(?:access|permission|dostęp\w*|zugriff|accès|acceso|accesso) (?:denied|forbidden|refused|zabroniony|verweigert|refusé|interdit|denegado|prohibido|negato|vietato)|odmowa dostępu"
    r"|\byou (?:are not (?:allowed|permitted|authori[sz]ed)|do not have (?:permission|access))|\b(?:connexion|login|authentication|anmeldung|logowanie|inicio de sesión|accesso) (?:(?:is|ist|jest|est|es|è) )?(?:required|requise|erforderlich|wymagane|requerido|richiesto)\b"
    r"|\b(?:technical (?:difficult\w+|problems?|errors?|issues?)|problem\w* techniczn\w+|technische[nrs]? (?:problem\w*|störung\w*|schwierigkeiten)|(?:problèmes?|difficultés?|erreurs?) techniques?|(?:problemas?|dificultades|errore?s) técnic[oa]s?|(?:problem[ai]|difficoltà|errori?e?) tecnic[oahi]{1,2})\b"
    r"|\b(?:bitte|please|veuillez|por favor|per favore|prosimy|proszę)\s+(?:\w+\s+){0,2}?(?:log in|sign in|try again|anmelden|vous connecter|réessayer|iniciar sesión|accedere|riprovare|(?:się )?zalogować|spróbować)\b"
    r"|\b(?:request|reference|incident|ray|trace|kennung)(?: id)?:? [0-9a-f]{6,}|\b(?:that|whether|if) you are (?:a )?(?:human|not a robot)"
)
#: Scripts, and that they are wanted.
SCRIPT = r"\bjava ?script\w*|\bno-?script\b|\bjs\b|\bscript(?:s|ing)?\b|\bskript\w*|\bskrypt\w*|\bcookies?\b|\bciasteczk\w*"
NEED = _words(
    r"enabled?  enabling  allow(?:ed|s)?  activated?  turn(?:ed)? (?:it |them )?(?:on|off)  switch(?:ed)? (?:it |them )?(?:on|off)  needs?  requires?d?  relies on  depends on  must  cannot  without  no  disabled  blocked  blocks  off  unsupported  necessary",
    r"włącz\w*  uruchom\w*  odblokuj\w*  wymaga\w*  zezw\w*  aktywuj\w*  obsług\w*  potrzebuj\w*  blokuj\w*  wyłączon\w*  bez  musi\w*  konieczn\w*",
    r"aktivier\w*  erlaub\w*  benötig\w*  erforderlich  müssen  muss  einschalten  zulassen  ohne  deaktiviert  blockiert  braucht  brauchen",
    r"active[zr]  autoris\w+  exige\w*  nécessit\w+  requi\w+  sans  désactivés?  bloqués?  doi(?:t|vent)  besoin",
    r"active  activar  activad[oa]s?  permita  permitid[oa]s?  permitir  necesita\w*  requier\w+  habilit\w+  desactivad[oa]s?  bloquead[oa]s?  sin  debe\w*  estén",
    r"abilita\w*  attiva\w*  consent\w+  richied\w+  necessari\w*  disattivat\w+  disabilitat\w+  bloccat\w+  senza  deve  devono  serve  servono",
)
#: Marks of a report: a year, and verbs that tell what was.
REPORT = r"\b(?:in|since|from|until|od|w|seit|im|bis|en|depuis|jusqu'en|desde|hasta|nel|dal|fino al)\W(?:1\d\d\d|20\d\d)\b|" + _words(
    r"was  were  had  went  became  became  built  gave  began  był[aoy]?  byli  został[aoy]?  zbudowan\w*  war  waren  wurden?  hatten?  était  étaient  fut  furent  avait  fue  fueron  era  eran  había  furono  erano  aveva  stato  stata"
)
_BROWSER = re.compile(r"\b(?:browser\w*|settings|przeglądar\w+|ustawieni\w+|einstellungen|navigateur|paramètres|navegador|ajustes|impostazioni)\b", re.I)
_PATH = r"(?<![\w/:])/\w+/\S+|\([45]\d\d\)"
_CLASSES = {name: re.compile(p, re.I) for name, p in (("system", SYSTEM), ("failure", FAILURE), ("address", ADDRESS), ("action", ACTION), ("status", STATUS), ("script", SCRIPT), ("need", NEED), ("report", REPORT), ("path", _PATH))}
#: Words of a text that one cue for a message, at least, has to speak for.
CUE_WORDS = 80

_FENCES = re.compile(r"```.*?```|~~~.*?~~~", re.S)
#: Lines set in by four blanks or a tab, after an empty line or one that ends in a colon.
_SET_IN = re.compile(r"((?:^|\n)[^\n]*:[ \t]*|(?:^|\n)[ \t]*)\n(?:(?: {4}|\t)[^\n]*(?:\n|$))+")
_QUOTED = re.compile(r"`[^`\n]++`|\"[^\"\n]++\"|“[^“”\n]++”|„[^„“”\n]++[”“]|«[^«»\n]++»|‘[^‘’\n]++’|(?<!\w)'(?=\S)[^'\n]++(?<=\S)'(?!\w)")
#: A sentence about code, in which a name between double underscores is a name.
CODE = re.compile(r"\b(?:python|class(?:es)?|module|klas[ay]|moduł|klasse|modul|classe|clase|módulo|modulo)\b|\b(?:method|function|attribute|metoda|funkcja|atrybut|methode|funktion|attribut|méthode|fonction|método|función|atributo|metodo|funzione|attributo)\W+(?:called |named )?__", re.I)
#: A sentence that explains templates; what it shows is no residue.
TUTORIAL = re.compile(
    _words(
        r"templates?  template engine  markers?  placeholders?  syntax  (?:is|are|gets?) (?:later )?(?:replaced|substituted)  stands for  examples?  notation  snippets?  variables?",
        r"szablon\w*  symbol\w* zastępcz\w*  znacznik\w*  składni\w*  zastępowan\w*  zastąpion\w*  przykład\w*  zmienn\w*",
        r"vorlagen?  platzhaltern?  syntax  ersetzt  beispiele?n?  markierung\w*  schreibweise  variablen?",
        r"modèles?  gabarits?  balises?  marqueurs?  syntaxe  remplacée?s?  exemples?",
        r"plantillas?  marcador\w*  sintaxis  se sustituyen?  sustituid[oa]s?  se reemplazan?  reemplazad[oa]s?  ejemplos?  notación",
        r"modell[oi]  segnaposto  sintassi  sostituit[oaie]  esemp[io]+  notazione  variabil[ei]",
    ),
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”')\]]*\s+|\n+")
_BRACKETED = re.compile(r"[\[(][^\[\]()\n]*+[\])]")
_WORD = re.compile(r"[^\W\d_]+")
#: What a text must hold to be looked at for the kinds of residue: linear-time automata over whole Arrow columns, which pass over most
#: texts. Each holds whenever the finer expressions above can match, as these contain one of its words or signs.
_SIGNS = r"\{\{|<%|\{%|[#$]\{|\{\pL|\$\pL|%\pL|<<|__|@@|::|\[\pL|(?i:\shere\))"
_VALUES = r"undefined|null|NULL|None|nil|NaN|nan|N/A|n/a|TBD|TBA|TODO|XXX|xxx|\?\?\?|%[sdif]|\{\d\}|\$\d|#(?:REF|VALUE|NAME|NULL|NUM|DIV|N/A)|\[object"
_LATIN = "(?i)" + "|".join(sorted(w for w in FILLER_WORDS if len(w) >= 5))


def _without_shown(text: str) -> str:
    """The text without code blocks and quotations."""
    text = _FENCES.sub("\n", text)
    if "\n    " in text or "\n\t" in text:
        text = _SET_IN.sub(r"\1\n", text)
    return _QUOTED.sub(" ' ", text)


def placeholders(text: str) -> int:
    """Unfilled places outside code, quotations and sentences that explain templates.

    Density decides about what is left: a text in which explaining sentences outnumber the unfilled places is a tutorial.
    """
    found = explained = 0
    grammars = [p for p, mark in zip(PLACEHOLDERS, _OPENERS) if mark in text and p.search(text)]
    if not grammars:
        return 0
    for sentence in _SENTENCE.split(text):
        here = sum(len(p.findall(sentence)) for p in grammars if not (p.pattern == _DUNDER and CODE.search(sentence)))
        if TUTORIAL.search(sentence):
            explained += 1
        else:
            found += here
    return found if found > explained or not explained else 0


def stands_in(sentence: str) -> bool:
    """Whether a sentence stands in for a text: it names a part of a text and calls it a sample, or says that it is to come or belongs here,
    or begins with the instruction to put or edit it, or is no more than part and place; and it does not report of the past."""
    has = {name: bool(p.search(sentence)) for name, p in _STANDING.items()}
    if has["edit"] and (has["topic"] or has["editing"]):
        return True
    bare = has["ends"] and not _WORD.search(re.sub("|".join(_STANDING[n].pattern for n in ("topic", "place", "small")), " ", sentence, flags=re.I))
    told = has["topic"] and (has["fake"] or has["future"] or has["place"] and has["goes"] or bare)
    return (told or has["compound"]) and not _CLASSES["report"].search(sentence)


def has_filler(text: str, latin: bool = True, stand_in: bool = True) -> bool:
    """Whether a paragraph consists mostly of filler: pseudo-Latin, one word over and over, or sentences that stand in for a text."""
    for paragraph in text.split("\n") if latin or stand_in else ():
        words = [w.lower() for w in _WORD.findall(paragraph)]
        if len(words) >= 8 and (sum(w in FILLER_WORDS for w in words) >= 0.7 * len(words) or len(set(words)) <= 2):
            return True
        if stand_in and words and FILLER.search(paragraph):
            standing = sum(len(_WORD.findall(s)) for s in _SENTENCE.split(paragraph) if stands_in(_BRACKETED.sub(" ", s)))
            if 2 * standing >= len(words):
                return True
    return False


def sentence_kind(sentence: str) -> str | None:
    """``script_notice`` or ``error_page`` if a sentence is one of such a message.

    A status, an idiom of failure or an instruction at its begin is enough, unless the sentence reports of the past. Otherwise a part of a
    system and a failure must come together, and what speaks for a message (these, an address to the reader, a path) must outweigh what
    speaks for a report. For scripts, the word and the want must come together with an address, a second want, or a system.
    """
    count = {name: len(_CLASSES[name].findall(sentence)) for name in ("status", "script", "failure", "action", "path", "address")}
    if not any(count[name] for name in ("status", "script", "failure", "action", "path")) and not (count["address"] and _BROWSER.search(sentence)):
        return None
    count |= {name: len(_CLASSES[name].findall(sentence)) for name in ("system", "need", "report")}
    report = min(2, count["report"]) if not count["status"] else 0
    if count["script"]:
        bare = "noscript" in sentence.lower()
        wanted = min(2, count["need"]) + sum(min(1, count[name]) for name in ("address", "system", "action")) + 2 * bare + (":" in sentence and count["need"] > 0)
        if (count["need"] or bare) and wanted - report >= 2:
            return "script_notice"
    if count["need"] and count["address"] and _BROWSER.search(sentence) and not report:
        return "script_notice"
    if count["status"] or (count["action"] or count["path"] and count["address"]) and not report:
        return "error_page"
    # A path stands for a part of a system.
    if (count["system"] or count["path"]) and count["failure"]:
        told = min(2, count["system"]) + min(2, count["failure"]) + min(1, count["address"]) + min(1, count["path"])
        if told - report >= 2:
            return "error_page"
    return None


def message_kind(sentences: list[str], hints: list[bool] | None = None) -> str | None:
    """``error_page`` or ``script_notice`` if such sentences make up the document; titles, lists of links and
    reference marks aside. ``hints`` say which sentences can be of that kind at all."""
    error = script = prose = 0
    for i, sentence in enumerate(sentences):
        words = len(_WORD.findall(sentence))
        if not words:
            continue
        kind = sentence_kind(sentence) if hints is None or hints[i] else None
        if kind == "script_notice":
            script += words
        elif kind == "error_page":
            error += words
        elif not _is_frame(sentence):
            prose += words
    if error + script == 0 or prose > error + script:
        return None
    return "script_notice" if script >= error else "error_page"


def _is_frame(sentence: str) -> bool:
    """A heading or a list of links rather than a sentence."""
    s = sentence.strip()
    return "|" in s or s.startswith("[") or s.startswith("==") or (s[-1:] not in ".!?…" and len(s) < 80)


def residue(text: str) -> list[str]:
    """The kinds of residue in a text."""
    plain = _without_shown(text)
    message = message_kind(_SENTENCE.split(plain))
    return [*_inner_kinds(plain, True, True, True, True), *([message] if message else [])]


def _inner_kinds(plain: str, signs: bool, values: bool, latin: bool, stand_in: bool) -> list[str]:
    """The kinds but for messages; the flags say what the text can hold at all."""
    kinds = []
    if signs and placeholders(plain):
        kinds.append("placeholder")
    if values and any(p.search(plain) for p in UNFILLED):
        kinds.append("unfilled_value")
    if has_filler(plain, latin, stand_in):
        kinds.append("filler")
    return kinds


def repeats_itself(text: str) -> bool:
    """Whether a paragraph is one or two words over and over."""
    for paragraph in text.split("\n"):
        words = paragraph.split()
        if len(words) >= 8 and len(set(words)) <= 2:
            return True
    return False


def _holds(texts: pa.Array, pattern: str, ignore_case: bool = False) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern, ignore_case=ignore_case).to_numpy(zero_copy_only=False).astype(bool)


def _loose(pattern: str) -> str:
    """A pattern for the automaton that matches wherever ``pattern`` does: without word boundaries, which the automaton
    knows for ASCII only, and with unbounded gaps, which keep it small."""
    return re.sub(r"\{0,\d+\}", "*", pattern.replace(r"\b", ""))


_STAND_IN = _loose(FILLER.pattern)
_CUES = re.sub(r"\(\?<[!=][^)]*\)", "", _loose("|".join((FAILURE, ACTION, STATUS, SCRIPT, _PATH, _BROWSER.pattern)).replace(r"^\W*", "")))


def _messages(rows: list[int], plain: list[str]) -> dict[int, str]:
    """The kinds of the rows whose text is a message. All their sentences pass the automaton in one go."""
    cut = [_SENTENCE.split(plain[i]) for i in rows]
    likely = _holds(pa.array([s for sentences in cut for s in sentences], pa.large_string()), _CUES, True).tolist()
    found, at = {}, 0
    for i, sentences in zip(rows, cut):
        kind = message_kind(sentences, likely[at : at + len(sentences)])
        at += len(sentences)
        if kind:
            found[i] = kind
    return found


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column(1)
            signs = _holds(texts, _SIGNS)
            values = _holds(texts, _VALUES)
            latin = _holds(texts, _LATIN)
            stand_in = _holds(texts, _STAND_IN, True)
            cues = pc.count_substring_regex(texts, _CUES, ignore_case=True).to_numpy(zero_copy_only=False)
            message = (cues > 0) & (cues * CUE_WORDS > pc.count_substring(texts, " ").to_numpy(zero_copy_only=False))
            plain = texts.to_pylist()
            latin |= [repeats_itself(t) for t in plain]
            look = signs | values | latin | stand_in | message
            plain = [_without_shown(t) if seen else "" for t, seen in zip(plain, look)]
            messages = _messages(message.nonzero()[0].tolist(), plain)
            found = []
            for i in look.nonzero()[0].tolist():
                kinds = _inner_kinds(plain[i], signs[i], values[i], latin[i], stand_in[i])
                found += [(part.column(0)[i].as_py(), kind) for kind in (*kinds, *([messages[i]] if i in messages else []))]
            if found:
                keys, kinds = zip(*found)
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(kinds, pa.string())], names=["id", "kind"])


def template_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind) of the records whose text holds residue instead of content; a record may have several kinds.

    Kinds: ``placeholder`` (an unfilled place, by one grammar per pair of delimiters), ``unfilled_value`` (a label or sentence
    with a value that was never filled), ``filler`` (a paragraph of it), ``error_page`` and ``script_notice`` (sentences of that
    kind make up the document). Code blocks, quotations and sentences that explain templates or code are discounted, as are sentences that report
    of the past. Messages are sought in texts that hold a cue for one in every :data:`CUE_WORDS` words.

    Texts are judged where they lie, without any shuffle. Defined cases: null, empty and short texts as such are no residue;
    a row that comes twice is reported twice; a null identifier is kept; an empty table gives no rows; other columns are ignored.
    """
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    return slim.mapInArrow(_detect, "id long, kind string")
