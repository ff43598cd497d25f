"""Personal information in free text: a semi-Markov conditional random field over spans.

Candidate spans of each type are enumerated with several possible boundaries and bounded
length; every span is scored as a whole (its shape, its words, what stands before and after
it), and dynamic programming over the text picks the best set of spans that do not overlap, so
boundaries and types are chosen together. Weights are trained here by gradient ascent on the
conditional likelihood (forward-backward over the same spans) of labelled sentences composed
from PATTERNS: contexts in four languages filled with made-up values, and contexts that only
look alike (addresses of machines, tickets, ranges, organisations).

Scale: one pass over the documents, no shuffle; the model is a dictionary of some thousand
weights, trained once on the driver from a fixed number of sentences. Whole texts are read, and
the work is linear in them because candidates have bounded length.

Defined cases: null and empty texts give nothing; a value that occurs twice in a document is one
row; the list of given names may be empty or hold nulls; repeated documents each give rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p

import pandas as pd
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "id", "address", "name")
Span = tuple[int, int, str, str]

UP = r"A-ZÀ-ÖØ-ÞŒŠŽ"
LOW = r"a-zß-öø-ÿœšž"
CAP = rf"[{UP}][{LOW}{UP}'’]*(?:-[{UP}][{LOW}{UP}'’]*)*"
TOWN = rf"[{UP}][{LOW}'’][{LOW}{UP}'’]*(?:[ -](?:(?:de|la|le|les|sur|am|an|der|del|los|las|upon|on|of)[ -])*[{UP}][{LOW}'’][{LOW}{UP}'’]*){{0,3}}"
POST = rf"(?: [{UP}]{{1,2}}\d{{1,2}}[{UP}]? ?\d[{UP}]{{2}}| [{UP}]{{2}} \d{{5}}(?:-\d{{4}})?| \d{{5}})?"
EMAIL = (
    re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|a|AT|arroba)\s?[\])}]\s?)[^\W_][\w-]*(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}]\s?)[^\W_][\w-]*)+"),
    re.compile(r"(?<![\w.+-])[^\W_][\w.+-]* at [\w-]+(?: dot [\w-]+)+"),
)
SPELLED_AT = re.compile(r"[\[({]\s?(?:at|a|AT|arroba)\s?[\])}]")
DIGITS = re.compile(r"(?<![\w.:/+@#-])(?:\(?\+\d{1,3}\)?|\(\d{2,5}\)|\d+)(?:(?:[ ./-]|[ ]?\(0\)[ ]?)?\(?\d+\)?)*(?![\w@]|[.-]\w)")
CODES = re.compile(rf"(?<![\w:/+@#.-])(?=[{UP}\d .-]*\d)(?:[{UP}]{{1,3}}[ -]?)?\d[\d{UP}]*(?:[ ./-](?:\d+[{UP}]?|[{UP}]{{1,2}}(?![{LOW}{UP}])))*(?:-?[{UP}](?![{LOW}{UP}\d]))?(?![\w@]|-\w)|(?<![\w:/+@#.-])[{UP}]\d[{UP}\d]{{4,}}(?:-\d)?(?![\w])")
STREET_EN = re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]? (?:{CAP} ){{1,4}}?(?:Avenue|Street|Road|Lane|Row|Square|Hill|Way|Close|Terrace|Court|Drive|Walk|Place|Yard|Crescent|Gardens|Grove|Mews|Quay|Alley|Boulevard|Ave|St|Rd)\b\.?(?:, (?:Apt|Flat|Unit|Suite|Room)\.? ?\w+)?,\s{TOWN}{POST}")
STREET_DE = re.compile(rf"(?<![\w.-])(?:(?:Am|An der|An den|Im|In der|Auf dem|Zum|Zur|Unter den|Alte[rn]?|Neue[rn]?|Große|Kleine) )?{CAP}(?: {CAP}){{0,2}} \d{{1,4}} ?[A-Za-z]?(?:, | in )(?:\d{{5}} )?{TOWN}")
STREET_FR = re.compile(rf"(?<![\w.-])\d{{1,5}}(?: ?(?:bis|ter)|[A-Za-z])?,? (?:rue|quai|avenue|boulevard|impasse|place|chemin|allée|cours|route|square|passage|sentier) [^,\n\d]{{2,50}}, (?:\d{{5}} )?{TOWN}")
STREET_ES = re.compile(rf"(?<![\w.-])(?:Calle|Plaza|Avenida|Camino|Paseo|Ronda|Carrera|Travesía|Callejón|C/|Avda\.) ?[^,\n\d]{{2,50}}?,? (?:n\.?º ?|nº ?|núm\.? ?|número )?\d{{1,4}}[A-Za-z]?(?:, \d+\.?º ?\w?)?, (?:\d{{5}} )?{TOWN}")
STREETS = (("en", STREET_EN), ("de", STREET_DE), ("fr", STREET_FR), ("es", STREET_ES))
PERSON_TOKEN = re.compile(rf"(?<![\w'’-])(?:[{UP}]\.|{CAP})(?![\w])")
LABEL = re.compile(
    r"(?i)(?:passport|passeport|pasaporte|reisepass|ausweis|id[ -]card|identity|identité|identidad|personal id|national|insurance|social|ssn|nino|steuer|fiscal|tax|tin\b|versicherung|dni|nie|nif|nir|licen[cs]e|permit)[^\d\n]{0,24}$"
)
#: Function and form words that never begin a person's name.
NEVER = frozenset(
    "the a an this that these those if in on at as after before during within under over since when while for from to by of and or but not no nothing we our please see about "
    "use call contact applicant according dear hello hi best kind regards wishes write reports letters page my your he she they it rule build node range queue ticket file record warn info error debug version subject "
    "der die das den dem des ein eine einen im in am an auf bei mit nach seit von vor zum zur und oder wenn wegen rund über bitte nächsten lauf siehe vorgang kontakt rückfragen viele grüße hallo frau herr "
    "le la les un une des du de au aux en dans sur sous par pour avec selon merci voir environ après pendant avant écrire appeler adresse bonjour cordialement mme mlle madame monsieur formulaire contact "
    "el los las una uno al del con sin por para según tras durante cerca véase conviene escriba llame avise saludos hola dirección contacto formulario señor señora sra dr mr mrs ms prof don doña".split()
)
ORGANISATION = frozenset("library review street project heimatverein museum archive journal gazette college university council society trust office library avenue road lane court bridge cove quarter hill square consortium bibliothèque musée revue archivo museo biblioteca verein institut verlag stiftung".split())


@lru_cache(1 << 14)
def plain(word: str) -> str:
    word = unicodedata.normalize("NFKD", word.lower().replace("ß", "ss"))
    return "".join(c for c in word if not unicodedata.combining(c))


def _digits(text: str) -> int:
    return sum(map(str.isdigit, text))


def candidates(text: str) -> list[Span]:
    """(start, end, type, kind) of every span that may be a value."""
    out: set[Span] = set()
    for k, may in enumerate(("@" in text or "＠" in text or SPELLED_AT.search(text), " at " in text and " dot " in text)):
        if may:
            out |= {(m.start(), m.end(), "email", f"form{k}") for m in EMAIL[k].finditer(text)}
    for m in DIGITS.finditer(text):
        s, e = m.span()
        if e - s < 7 or _digits(m[0]) < 7 or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", m[0]):
            continue
        ends = [e] + [s + g.start() for g in re.finditer(r"[ ./-]", m[0])][::-1][:3]
        begins = [s] + [s + g.end() for g in re.finditer(r"[ ]", m[0])][:1]
        for b in begins:
            for x in ends:
                piece = text[b:x]
                if x > b and 7 <= _digits(piece) <= 15 and piece.count("(") == piece.count(")"):
                    out.add((b, x, "phone", "digits"))
    for m in CODES.finditer(text):
        s, e = m.span()
        if e - s < 5 or _digits(m[0]) < 5:
            continue
        ends = [e] + [s + g.start() for g in re.finditer(r"[ ./-]", m[0])][::-1][:2]
        begins = [s] + [s + g.end() for g in re.finditer(r"(?<=[^\W\d])[ -](?=\d)", m[0])][:1]  # a label's last letters are not the number's
        for s, x in ((b, x) for b in begins for x in ends):
            if x > s and 6 <= sum(c.isalnum() for c in text[s:x]) <= 18 and _digits(text[s:x]) >= 5:
                out.add((s, x, "id", "code"))
    for kind, pattern in STREETS:
        for m in pattern.finditer(text):
            s, e = m.span()
            out.add((s, e, "address", kind))
            if kind == "de":  # the street may begin at a later word
                out |= {(s + g.end(), e, "address", kind) for g in re.finditer(rf" (?=[{UP}])", re.split(r" \d", m[0])[0])}
            words = [g.start() for g in re.finditer(r"[ ]", m[0])]
            for w in words[-2:]:  # the town may have fewer words
                if text[s + w - 1] not in ",n" and text[s : s + w].rstrip(",")[-1:].isalpha():
                    out.add((s, s + w, "address", kind))
    tokens = [(m.start(), m.end(), m[0]) for m in PERSON_TOKEN.finditer(text)]
    for i, (s, e, w) in enumerate(tokens):
        initial = w.endswith(".")
        if not initial and (plain(w) in NEVER or w.lower() in NEVER or len(w) < 2):
            continue
        if i + 1 >= len(tokens):
            break
        s2, e2, w2 = tokens[i + 1]
        gap = text[e:s2]
        if gap == " ":
            if w2.endswith("."):
                if i + 2 < len(tokens) and text[e2 : tokens[i + 2][0]] == " " and not tokens[i + 2][2].endswith(".") and len(tokens[i + 2][2]) > 1:
                    out.add((s, tokens[i + 2][1], "name", "initials" if initial else "middle"))
            elif len(w2) > 1:
                out.add((s, e2, "name", "initial" if initial else "plain"))
                if i + 2 < len(tokens) and text[e2 : tokens[i + 2][0]] == " " and not tokens[i + 2][2].endswith(".") and not initial:
                    out.add((s, tokens[i + 2][1], "name", "three"))
        elif gap == ", " and not initial:
            out.add((s, e2, "name", "turned initial" if w2.endswith(".") else "turned"))
            if i + 2 < len(tokens) and tokens[i + 2][2].endswith(".") and text[e2 : tokens[i + 2][0]] == " " and not w2.endswith("."):
                out.add((s, tokens[i + 2][1], "name", "turned middle"))
    return sorted(out)


LAST_WORDS = re.compile(r"(?:([\w'’.-]+)\W+)?([\w'’]+[.:]?)[\s\"(<\[:]*$")
FIRST_WORDS = re.compile(r"^[\s\")>\],;:.]*([\w'’]+)(?:\W+([\w'’]+))?")


SHAPES = {ord(c): "9" for c in "0123456789"}
CALL = re.compile(r"(?i)(?:tel|tél|phone|fax|call|mobil|number is|operator on|appeler|llame|anruf|ruf|telefon|erreichbar|reach)[^\d\n]{0,20}$")
GROUPS = re.compile(r"[ ./()-]+")
GOES_ON = re.compile(r"[ ./-]?\d|[ ]?[A-Z](?![A-Za-z])")
WENT_BEFORE, LETTER_BEFORE = re.compile(r"[\w)][ ./-]?$"), re.compile(r"[^\W\d][ ]$")
POST_CODE, CODE_NEXT, CAP_NEXT = re.compile(r"\d{5}|[A-Z]{2}\d \d[A-Z]{2}"), re.compile(rf" [{UP}]{{2}}\d"), re.compile(rf" [{UP}]")
CAP_BEFORE, CAP_AFTER, COMMA_CAP, MIDDLE_AFTER = re.compile(rf"[{UP}][{LOW}{UP}]+ $"), re.compile(rf",? [{UP}][{LOW}{UP}]"), re.compile(rf", [{UP}]"), re.compile(rf" [{UP}]\.")
STOP_BEFORE, SHOUT_AFTER, SHOUT_BEFORE = re.compile(r"[.!?] $"), re.compile(rf"\W{{0,2}}[{UP}]{{2,}}"), re.compile(rf"[{UP}]{{2,}}\W{{0,2}}$")
UPPER, LOWER = re.compile(rf"[{UP}]"), re.compile(rf"[{LOW}]+")
TITLES = frozenset("dr mr mrs ms prof mme m frau herr sra sr señora señor doña don madame monsieur".split())


def surroundings(text: str, s: int, e: int) -> tuple[str, str, str, str, str, str, bool, bool]:
    """(text before, text after, last word and last but one before, first and second word after, whether a line begins or ends here)."""
    before, after = text[max(0, s - 60) : s], text[e : e + 40]
    line_start, line_end = not before.strip(" ") or before.rstrip(" ").endswith("\n"), not after or after.lstrip(" ").startswith("\n") or not after.strip()
    m = LAST_WORDS.search(before.rsplit("\n", 1)[-1])
    prev, prev2 = (m[2].lower(), (m[1] or "").lower()) if m else ("^", "^")
    m = FIRST_WORDS.search(after.split("\n", 1)[0])
    nxt, nxt2 = (m[1].lower(), (m[2] or "").lower()) if m else ("$", "$")
    return before, after, prev, prev2, nxt, nxt2, line_start, line_end


def features(text: str, span: Span, given: frozenset[str], emails: str, around: tuple | None = None) -> list[str]:
    """Features of a whole candidate span; the type is put before each by the caller."""
    s, e, kind, form = span
    value = text[s:e]
    before, after, prev, prev2, nxt, nxt2, line_start, line_end = around or surroundings(text, s, e)
    f = ["bias", f"form:{form}", f"prev:{prev}", f"next:{nxt}", f"next2:{nxt} {nxt2}", f"prev2:{prev2} {prev}"]
    if kind in ("phone", "id"):
        shape = LOWER.sub("a", UPPER.sub("A", value.translate(SHAPES)))
        label, call = LABEL.search(before) is not None, CALL.search(before) is not None
        f += [f"shape:{shape}", f"label:{label}", f"call:{call}", f"digits:{_digits(value)}", f"plus:{value.lstrip('(')[:1] == '+' or value[:2] == '00'}", f"groups:{min(5, len(GROUPS.findall(value)))}"]
        f += [f"letters:{any(map(str.isalpha, value))}", f"whole:{not GOES_ON.match(after)}", f"starts:{not WENT_BEFORE.search(before) or LETTER_BEFORE.search(before) is not None}", f"lines:{line_start}{line_end}", f"label&call:{label}{call}"]
    elif kind == "email":
        f += [f"dots:{min(2, value.count('.') + value.lower().count('dot'))}", f"top:{len(value.rsplit('.', 1)[-1]) > 1}"]
    elif kind == "address":
        f += [f"post:{POST_CODE.search(value[4:]) is not None}", f"cap next:{CAP_NEXT.match(after) is not None}", f"code next:{CODE_NEXT.match(after) is not None}", f"comma end:{value[-1] == ','}", f"words:{min(12, len(value.split()))}"]
    else:
        parts = [w.strip(",") for w in value.split()]
        if form.startswith("turned"):
            first, last = parts[1], parts[0]
        else:
            first, last = parts[0], parts[-1]
        known = plain(first) in given or plain(first.split("-")[0]) in given
        caps = value.upper() == value and len(value) > 4
        f += [
            f"given:{known}", f"given&form:{known} {form}", f"mail:{bool(emails) and len(last) > 3 and plain(last) in emails}", f"caps:{caps}", f"organisation:{not ORGANISATION.isdisjoint([p.lower() for p in parts])}",
            f"lines:{line_start}{line_end}", f"cap before:{prev not in NEVER and CAP_BEFORE.search(before) is not None}", f"cap after:{CAP_AFTER.match(after) is not None}", f"comma cap:{COMMA_CAP.match(after) is not None}", f"middle after:{MIDDLE_AFTER.match(after) is not None}",
            f"stop before:{STOP_BEFORE.search(before) is not None}", f"last never:{plain(last.strip('.')) in NEVER}", f"swapped given:{plain(last) in given}",
            f"shouting:{caps and bool(SHOUT_AFTER.match(after) or SHOUT_BEFORE.search(before.rsplit(chr(10), 1)[-1]))}", f"title:{prev.rstrip('.') in TITLES}",
        ]
    return f


Prepared = tuple[list[Span], list[list[str]]]


class SpanModel:
    def __init__(self, given_names: list[str | None] = ()):
        self.given = frozenset(plain(g) for g in given_names if g)
        self.weights: dict[str, dict[str, float]] = {t: {} for t in TYPES}

    def prepared(self, text: str) -> Prepared:
        """(candidate spans by their ends, the features of each)."""
        spans = sorted(candidates(text), key=lambda c: (c[1], c[0], c[2], c[3]))
        emails = plain(" ".join(text[s:e] for s, e, t, _ in spans if t == "email")) if spans else ""
        around: dict[tuple[int, int], tuple] = {}
        fs = []
        for c in spans:
            place = c[:2]
            if place not in around:
                around[place] = surroundings(text, *place)
            fs.append(features(text, c, self.given, emails, around[place]))
        return spans, fs

    def scores(self, prepared: Prepared) -> list[float]:
        """The score of each span: the sum of its features' weights."""
        return [sum([get(x, 0.0) for x in f]) for get, f in ((self.weights[c[2]].get, f) for c, f in zip(*prepared))]

    def decode(self, text: str) -> list[Span]:
        """The best set of spans that do not overlap."""
        spans, fs = self.prepared(text)
        scores = self.scores((spans, fs))
        ends = [c[1] for c in spans]
        best, back = [0.0], []
        for k, (c, score) in enumerate(zip(spans, scores)):
            p = bisect_right(ends, c[0], 0, k)
            take = best[p] + score
            back.append(p if take > best[k] else -1)
            best.append(max(best[k], take))
        out, k = [], len(spans)
        while k:
            if back[k - 1] >= 0:
                out.append(spans[k - 1])
                k = back[k - 1]
            else:
                k -= 1
        return out[::-1]

    def gradient(self, prepared: Prepared, gold: set[tuple[int, int, str]]) -> dict[tuple[str, str], float]:
        """Observed minus expected features of one labelled text, by type and feature."""
        spans, fs = prepared
        scores = self.scores(prepared)
        n = len(spans)
        ends = [c[1] for c in spans]
        add = lambda a, b: max(a, b) + log1p(exp(-abs(a - b)))
        alpha, before = [0.0], []
        for k in range(n):
            p = bisect_right(ends, spans[k][0], 0, k)
            before.append(p)
            alpha.append(add(alpha[k], alpha[p] + scores[k]))
        # messages from the right, pushed along the same edges
        marginal = [0.0] * n
        weight = [float("-inf")] * (n + 1)  # log probability that the best path passes state k
        weight[n] = 0.0
        for k in range(n, 0, -1):
            if weight[k] == float("-inf"):
                continue
            take = weight[k] + alpha[before[k - 1]] + scores[k - 1] - alpha[k]
            skip = weight[k] + alpha[k - 1] - alpha[k]
            marginal[k - 1] = exp(min(0.0, take))
            p = before[k - 1]
            weight[p] = take if weight[p] == float("-inf") else add(weight[p], take)
            weight[k - 1] = skip if weight[k - 1] == float("-inf") else add(weight[k - 1], skip)
        g: dict[tuple[str, str], float] = {}
        seen: set[tuple[int, int, str]] = set()
        for c, f, q in zip(spans, fs, marginal):
            key = (c[0], c[1], c[2])
            d = (key in gold and key not in seen) - q
            if key in gold:
                seen.add(key)
            if abs(d) > 1e-4:
                for x in f:
                    g[(c[2], x)] = g.get((c[2], x), 0.0) + d
        return g

    def fit(self, labelled: list[tuple[str, set[tuple[int, int, str]]]], epochs: int = 6, rate: float = 0.3) -> "SpanModel":
        squares: dict[tuple[str, str], float] = {}
        texts = [(self.prepared(text), gold) for text, gold in labelled]
        order = list(range(len(texts)))
        rng = random.Random(11)
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                for (kind, x), d in self.gradient(*texts[i]).items():
                    weights = self.weights[kind]
                    d -= 1e-4 * weights.get(x, 0.0)
                    squares[(kind, x)] = squares.get((kind, x), 0.1) + d * d
                    weights[x] = weights.get(x, 0.0) + rate * d / squares[(kind, x)] ** 0.5
        return self

    def redact(self, text: str) -> str:
        """The text with every value replaced by the placeholder of its type."""
        out, at = [], 0
        for s, e, kind, _ in self.decode(text):
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*out, text[at:]])


def extract(documents: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, pii_type, pii_text: distinct values per document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [(d, *v) for d, t in zip(b["doc_id"], b["text"]) if t for v in sorted({(k, t[s:e]) for s, e, k, _ in m.decode(t)})]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, pii_type string, pii_text string")


def redact(documents: DataFrame, model: SpanModel) -> DataFrame:
    """documents with ``text`` replaced; other columns are kept as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            b = b.copy()
            b.isetitem(at, [m.redact(t) if t else t for t in b.iloc[:, at]])
            yield b

    return documents.mapInPandas(run, documents.schema)
