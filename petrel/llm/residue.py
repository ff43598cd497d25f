"""Lines and addresses that stand in place of content: unfilled placeholders, filler text, known notices.

These are detectors for single lines and addresses; exclusion.py weighs them with what all pages
say about a line (how many sites repeat it, whether it names the page it stands on).

Defined cases: null or empty contents (redirects) are no residue; null urls have no
placeholder; repeated rows are judged alike.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from urllib.parse import unquote

PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{.*?\}|#\{.*?\}|%%\s?[A-Za-z][\w. ]*%%|@@\s?[A-Za-z][\w. ]*@@|\*\*\*\s?[A-Za-z][\w. ]*\*\*\*"
    r"|\[\[.*?\]\]|\$[A-Za-z_][\w.]*\$|__[A-Za-z][\w.]*?__(?!\w)|\{[A-Za-z_][\w.]*\}|\[[A-Za-z_][\w]*(?:[.-][\w]+)*\]|%[A-Z][A-Z_]+%|\[object \w+\]"
)
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum".split()
)
FILLER = re.compile(
    r"(?i)\b(?:(?:headline|title|text|caption|paragraph|content|description) goes here|insert (?:\w+ )*here|sample text|dummy text|placeholder text|"
    r"replace it with your own|demo entry|add a (?:short )?(?:description|text|title)|edit or delete it|coming soon|platzhalter(?:text)?|blindtext|beispieltext|"
    r"hier (?:steht|eingeben|einfügen)|überschrift hier|texte? d'exemple|texte factice|à saisir ici|votre (?:titre|texte) ici|faux texte|"
    r"texto de (?:ejemplo|muestra|relleno|prueba)|escriba aquí|(?:título|titular|texto) aquí|aquí va (?:el|su|un)|sustituir por|tbd|todo|untitled|lorem ipsum)\b"
)
NOTICE = re.compile(
    r"(?i)(?:\b(?:enable|activate|turn on|switch (?:it )?on|requires?|allow) (?:\w+ ){0,2}(?:javascript|scripts?)\b|javascript is (?:disabled|off|required)|\bturn on scripts\b|site requires scripts"
    r"|\bnot (?:be )?found\b|nothing lives at|no longer (?:available|exists?)|page (?:does not|doesn't) exist|has been (?:removed|deleted)|\bgone\b.{0,12}$"
    r"|internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|scheduled maintenance|under maintenance"
    r"|too many requests|access (?:is )?denied|\bforbidden\b|not authori[sz]ed|permission to (?:view|access)|have been blocked|checking your browser|session has expired|sign in again|rate limit"
    r"|something went wrong|an (?:unexpected )?error (?:has )?occurred|traceback \(most recent|fatal error|uncaught exception|stack trace|establishing a (?:database )?connection|connection to the database|upstream host|segmentation fault|null pointer|captcha|verify (?:that )?you are"
    r"|(?:bitte )?aktivieren sie javascript|javascript ist (?:deaktiviert|erforderlich)|benötigt skripte|(?:wurde )?nicht gefunden|nicht mehr verfügbar|(?:zurzeit|derzeit) nicht (?:erreichbar|verfügbar)|wartungsarbeiten"
    r"|interner (?:server)?fehler|etwas ist schief|ein (?:unerwarteter )?fehler ist aufgetreten|zugriff verweigert|sitzung ist abgelaufen|zu viele anfragen|datenbankverbindung"
    r"|activer javascript|javascript est (?:désactivé|requis)|exige des scripts|(?:est )?introuvable|n'est plus (?:disponible|en ligne)|n'existe (?:plus|pas)|erreur interne|une erreur (?:inattendue )?(?:est survenue|s'est produite)|accès (?:refusé|interdit)|session a expiré|en maintenance|(?:temporairement|momentanément) indisponible|trop de requêtes|réessayer plus tard"
    r"|active javascript|activ(?:ar|e) javascript|necesita scripts|javascript está (?:desactivado|deshabilitado)|no se ha encontrado|no encontrada|ya no (?:está|existe)|no (?:está )?disponible|error interno|algo (?:ha salido|salió) mal|se ha producido un error|acceso (?:denegado|prohibido)|sesión ha (?:caducado|expirado)|en mantenimiento|demasiadas (?:peticiones|solicitudes)|inténtelo más tarde)"
)
WORD = re.compile(r"[^\W_]+")
NOTICE_WORDS = 24


@lru_cache(1 << 16)
def line_kind(line: str) -> str | None:
    """placeholder, filler, notice, or None for ordinary text."""
    if "&" in line:
        line = html.unescape(line)
    left, n = PLACEHOLDER.subn(" ", line)
    if n and len(WORD.findall(left)) <= 10:
        return "placeholder"
    tokens = [w.lower() for w in WORD.findall(line)]
    if not tokens:
        return None
    if len(tokens) >= 3:
        top = max(tokens.count(w) for w in set(tokens))
        latin = sum(w in LATIN for w in tokens)
        if latin >= 0.7 * len(tokens) or (top >= 3 and len(set(tokens)) <= max(2, len(tokens) // 3)):
            return "filler"
    if len(tokens) <= 12 and (FILLER.search(line) or all(re.fullmatch(r"(x+|asdf\w*|qwert\w*|foo|bar|bla+h*|test)", w) for w in tokens)):
        return "filler"
    if len(tokens) <= NOTICE_WORDS and NOTICE.search(line):
        return "notice"
    return None


URL_VALUE = re.compile(
    r"(?i)^(?:\{\{.*\}\}|\{%.*%\}|<%.*%>|\$\{.*\}|#\{.*\}|\{\w[\w.]*\}|\[\[.*\]\]|\[[a-z][\w. -]*\]|:[a-z_]\w*|__[a-z]\w*?__|%%.*%%|@@.*@@|\$\w+\$|%[sdi]|null|undefined|nan|none|nil|\[object \w+\]|\(null\)|<\w+>)$"
)
URL_INNER = re.compile(r"\{\{[^/?#]*\}\}|\{%.*?%\}|<%.*?%>|\$\{[^/?#]*\}|#\{[^/?#]*\}|\[object \w+\]|__[A-Z][A-Z_]*__|%%[A-Za-z_.]+%%|@@[A-Za-z_.]+@@")


@lru_cache(1 << 12)
def _segment(value: str) -> bool:
    return bool(URL_VALUE.match(value))


def url_unfilled(url: str | None) -> bool:
    """Whether a part of the path or a parameter of the address was never filled in."""
    if not url:
        return False
    m = re.match(r"[a-zA-Z][\w+.-]*://[^/?#]*(.*)$", url, re.S)
    rest = m[1] if m else url
    if not rest or rest == "/":
        return False
    plain = unquote(rest) if "%" in rest else rest
    if ("{" in plain or "<%" in plain or "__" in plain or "%%" in plain or "@@" in plain or "[object" in plain) and URL_INNER.search(plain):
        return True
    path, _, query = plain.partition("?")
    for p in path.split("/"):
        if p and _segment(p.partition("#")[0] or p):
            return True
    for pair in (query.partition("#")[0]).split("&"):
        if _segment(pair.partition("=")[2]):
            return True
    return False


NUMBERS = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
ADDRESS = re.compile(r"\w+://\S+")


@lru_cache(1 << 16)
def _numberless(word: str) -> str:
    return NUMBERS.sub("0", word)


def line_key(line: str) -> str:
    """A line without letter case, addresses, numbers and hexadecimal references."""
    low = line.lower()
    if "://" in low:
        low = ADDRESS.sub(" 0 ", low)
    return " ".join([w if w.isalpha() else _numberless(w) for w in WORD.findall(low)])


def slug_words(url: str | None) -> set[str]:
    m = re.match(r"[a-zA-Z]+://[^/?#]*([^?#]*)", url or "")
    return {w for w in WORD.findall((m[1] if m else "").lower()) if len(w) > 3 and not w.isdigit()}
