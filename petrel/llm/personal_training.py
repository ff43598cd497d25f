"""Labelled sentences for the span model, composed from contexts and made-up values."""

from __future__ import annotations

import random
import re
from functools import lru_cache

from petrel.llm.personal import SpanModel, plain

#: Contexts per language; {n} name, {e} email, {p} phone, {i} labelled identity number, {a} address.
CONTEXTS = {
    "en": [
        "cc {n} on the ticket.", "According to {n}, the list is final.", "Please ask {n} before the next run.", "Dr. {n} reviewed the files.", "{n} wrote to us twice about this.", "The permission was signed by {n}.",
        "Mr. {n} called again.", "Mrs. {n} left a note.", "Kind regards\n{n}\n{e}\n{p}", "Best wishes\n{n}\n{p}", "Best wishes\n{n}\n{e}", "Best wishes\n{n}", "Regards,\n{n}", "The request came from {n} in spring.", "We met {n} yesterday.",
        "Write to {e} if it fails.", "Contact <{e}> for access.", "From: {e}", "Reports go to {e}, please.", "The owner (mailto:{e}) wants it removed.", "The owner ({e}) agreed.", "{e}",
        "You can reach the operator on {p}.", "My number is {p}, ask for the desk.", "Phone/fax: {p}", "Call {p} during office hours.", "Tel. {p}", "Mobile: {p}", "{p}",
        "The form still shows {i} in clear text.", "Page two lists {i}, which must not be public.", "Applicant: {i}.", "Her {i} was visible.",
        "The scan shows a home address, {a}, next to a photo.", "Letters reach the owner at {a}.", "Our office moved to {a}.", "Address: {a}", "She lives at {a}.",
    ],
    "de": [
        "{n} hat zweimal wegen der Seite geschrieben.", "Bitte vor dem nächsten Lauf {n} fragen.", "Die Freigabe stammt von Frau {n}.", "Die Freigabe stammt von Herrn {n}.", "Laut {n} ist die Liste fertig.", "Viele Grüße\n{n}\n{p}", "Viele Grüße\n{n}\n{e}", "Viele Grüße\n{n}",
        "Kontakt: {e}", "Rückfragen an {e} richten.", "Der Betreiber ({e}) bittet um Löschung.", "Tel.: {p}", "Telefonisch erreichbar unter {p}.", "Rufnummer {p}, bitte vormittags.", "Im Formular: {i}.", "Auf Seite zwei steht {i} im Klartext.",
        "Die Anschrift lautet {a}.", "Post bitte an {a}.", "Wohnhaft {a}.",
    ],
    "fr": [
        "{n} nous a écrit deux fois.", "Selon Mme {n}, la liste est close.", "Selon M. {n}, la liste est close.", "Merci de prévenir {n} avant la reprise.", "Cordialement\n{n}\n{e}", "Cordialement\n{n}\n{p}", "Cordialement\n{n}",
        "Contact : {e}", "Écrire à {e} en cas d'échec.", "Tél. {p}", "Appeler le {p} le matin.", "La page deux montre {i} en clair.", "Formulaire : {i}.", "Adresse : {a}.", "Le courrier arrive au {a}.",
    ],
    "es": [
        "Según {n}, la lista está cerrada.", "Avise a {n} antes de la próxima cosecha.", "{n} nos escribió dos veces.", "La Sra. {n} firmó el permiso.", "Saludos\n{n}\n{e}", "Saludos\n{n}\n{p}", "Saludos\n{n}",
        "Contacto: {e}", "Escriba a {e} si falla.", "Tel. {p}", "Llame al {p} por la mañana.", "La página dos muestra {i} sin ocultar.", "Formulario: {i}.", "Dirección: {a}.", "El correo llega a {a}.",
    ],
}
#: Sentences without personal values; {c} capital word, {h} hex, {d} digit.
NEUTRAL = [
    "2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} INFO The reader kept {d}{d}{d} records in order.", "2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} WARN See the section on short reads.", "2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} ERROR Die Warteschlange und die Ernte ruhen.", "2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} ERROR Merci de vérifier le lecteur.",
    "Node 192.0.2.{d}{d} answered with code 503.", "Range {d}{d}{d}-00-{d}{d}{d}{d} of the block list was skipped.", "Range {d}{d}{d}-{d}{d}-{d}{d}{d}{d} was skipped.", "Queue depth was {d}{d}{d}{d}{d} at 2023{d}{d}{d}{d}, ratio 0.{d}{d}{d}{d}.", "Build 2.{d}{d}.{d}{d}{d} runs on port 80{d}{d}.",
    "Ticket QA-{d}{d}{d}{d}{d} covers the same host.", "Le billet QA-{d}{d}{d}{d}{d} concerne le même hôte.", "QA-{d}{d}{d}{d}{d} [closed]", "Vorgang QA-{d}{d}{d}{d}{d} betrifft denselben Host.", "La ficha QA-{d}{d}{d}{d}{d} trata del mismo servidor.", "See file {C}-2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}-0000{d}{d}.warc.gz at offset {d}{d}{d}{d}{d}{d}{d}.", "Siehe Datei {C}-2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}-0000{d}{d}.warc.gz ab Position {d}{d}{d}{d}{d}{d}{d}.",
    "Rule /user@[0-9]+/ matches nothing.", "Use @@ as the delimiter, never a@b.", "The digest sha1:{H}{H} appears {d}{d} times.", "Record <urn:uuid:{h}-{h4}-{h4}-{h4}-{h}{h4}> is the witness.",
    "The {c} {c} Review and the {c} {c} Library gave consent.", "The {c} Street project has its own seed group.", "Der {c}er Heimatverein stimmte zu.", "La {c} Revue a donné son accord.", "El Museo de {c} dio permiso.", "The {c} Museum and the {c} Trust agreed.", "We crawled {c} {c} last week.", "In {c} the seeds produced 11 captures.",
    "Die Redaktion bittet um Notizen zu langen Umleitungsketten.", "Der Kopfzeilenleser und der Tiefenlauf widersprechen sich.", "Der Gzip-Leser und die Wahlernte ruhten.", "Am Ende des Laufs wurden 36 Kopfzeilen geprüft.", "In 1995 the same seeds produced {d}{d} captures.", "Version 8.{d}{d}", "== The dump tool ==",
    "Hello all,\n\nThe crawl of {c} ended.", "Le lecteur gzip et la collecte divergent sur {d}{d}{d} empreintes.", "Voir le fichier {C}-2023{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}-0000{d}{d}.warc.gz à la position {d}{d}{d}{d}{d}{d}{d}.", "Um 2023-0{d}-1{d} begann der Wochenlauf.", "Order no. {d}{d}{d} {d}{d}{d} {d}{d}{d} was closed.", "nur {c} {c} vollständig bewahrt erneut, zurückzieht, {c} {c} für den Vermerk.", "be a die closed. {c} {c} holds no witness of {c} {c} whether.", "{c} {c} que las copias {c} conserva.", "des copies {c} {c} qui reste {c} {c}.", "Eine Zeugin prüft die {c} {c} nach zwölf Tagen.", "{c}. {c} {c} sofern das {c} nennt {c} {c} und {c}.",
    "Of {d} witnesses only 40 mention a lossy copy. How many hops separate them? Consider this case.", "It is agreed that the earlier capture is preferred. Later the agency forwards a copy.", "The job took {d}{d}{d} {d}{d}{d} {d}{d}{d} milliseconds.",
]
LABELS = {
    "en": ("passport no. {P}", "ID card {P}", "identity number: {P}", "personal id {P}", "SSN {S}", "social security number {S}", "national insurance number {N}", "NI number {N}", "tax id {T}"),
    "de": ("Reisepass {P}", "Personalausweis {P}", "Personalausweis Nr. {P}", "Reisepass-Nr. {P}", "Ausweisnummer {P}", "Steuer-ID {T}", "Steuernummer {T}", "Sozialversicherungsnummer {V}"),
    "fr": ("passeport {P}", "carte d'identité {P}", "numéro de sécurité sociale {R}", "numéro fiscal {T}"),
    "es": ("pasaporte n.º {P}", "DNI {D}", "NIE {E}", "NIF {D}", "número de la seguridad social {T}"),
}
SIGNS = {
    "P": ("@0000000-0", "@@ 000 0000", "@00000000", "@0@000000", "@@0000000", "000000000"), "S": ("000-00-0000", "000 00 0000", "000000000"), "N": ("QQ000000C", "QQ 00 00 00 C"),
    "T": ("00 000 000 000", "00000000000", "00/000/00000", "00 000 00 00 000"), "V": ("00 000000 @ 000", "00000000@000"), "R": ("0 00 00 00 000 000 00", "000000000000000"), "D": ("00000000-@", "00000000@", "00.000.000-@"), "E": ("@0000000@", "@-0000000-@"),
}
PHONES = {
    "en": ("020 7946 0000", "01632 960000", "+441632960000", "+44 7700 900000", "+44 (0)20 7946 0000", "(212) 555-0000", "212.555.0000", "212-555-0000", "+1 415 555 0000", "1-800-555-0000", "555-0000", "0044 20 7946 0000"),
    "de": ("030 23125 000", "030/23125-000", "+49 30 23125 000", "+49 (0)30 23125 000", "0049 30 23125000", "+493023125000"),
    "fr": ("01.99.00.00.00", "01 99 00 00 00", "0199000000", "+33199000000", "+33199 000000", "+33 1 99 00 00 00", "0033 1 99 00 00 00"),
    "es": ("555 000 000", "555000000", "+34 555 000 000", "(+34) 555000000", "(+34) 555 00 00 00", "0034 555 000 000"),
}
PARTS = (("bram", "toll", "quer", "hal", "dor", "fens", "lind", "mar", "wes", "kel", "ost", "ven", "gri", "sal", "pem", "rav"), ("wick", "and", "mo", "ling", "ber", "ta", "stead", "ell", "ig", "hurst", "ron", "mann", "ville", "ero", "eau", "ton"))


def _word(r: random.Random) -> str:
    return (r.choice(PARTS[0]) + r.choice(PARTS[1]) + (r.choice(PARTS[1]) if r.random() < 0.25 else "")).capitalize()


def _signs(r: random.Random, form: str) -> str:
    return re.sub("[0@]", lambda m: r.choice("0123456789") if m[0] == "0" else r.choice("XLTWKZCY"), form)


def _name(r: random.Random, given: list[str]) -> tuple[str, str]:
    first = r.choice(given) if given and r.random() < 0.6 else _word(r)
    last = _word(r) + (f"-{_word(r)}" if r.random() < 0.15 else "")
    p = r.random()
    middle = f" {r.choice('ABCDEFGHJKLMRST')}." if r.random() < 0.15 else ""
    whole = f"{first[0]}. {last}" if p < 0.12 else f"{last}, {first}{middle}" if p < 0.28 else f"{last}, {first[0]}." if p < 0.31 else f"{first}{middle} {last}"
    return (whole.upper() if r.random() < 0.1 else whole), last


def _email(r: random.Random, last: str) -> str:
    local = r.choice((plain(last), f"{r.choice('abcd')}{plain(last)}", f"{_word(r).lower()}{r.choice('._-')}{plain(last)}", f"{_word(r).lower()}+crawl", f"{plain(last)}{r.randrange(99)}"))
    host = [r.choice(("mail.", "post.", "")) + _word(r).lower(), r.choice(("example", "test", "org", "com"))]
    at, dot = r.choice((("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")))
    whole = local + at + dot.join(".".join(host).split("."))
    return whole.title() if r.random() < 0.08 and at == "@" else whole


def _address(r: random.Random, lang: str) -> str:
    number = f"{r.randrange(1, 250)}{r.choice(('', '', '', 'a', 'B'))}"
    town = _word(r) if r.random() < 0.6 else f"{_word(r)} {_word(r)}"
    zip5 = _signs(r, "00000 ") if r.random() < 0.5 else ""
    if lang == "en":
        street = " ".join(_word(r) for _ in range(r.randrange(1, 3))) + " " + r.choice(("Avenue", "Street", "Road", "Lane", "Court", "Close", "Terrace", "Square"))
        return f"{number} {street}{r.choice(('', '', f', Apt. {r.randrange(1, 9)}'))}, {town}{r.choice(('', f' ZX{r.randrange(9)} {r.randrange(9)}QQ'))}"
    if lang == "de":
        street = r.choice((f"{_word(r)}straße", f"{_word(r)}weg", f"{_word(r)}platz", f"{_word(r)}er Allee", f"Am {_word(r)}tor", f"Alte {_word(r)}gasse"))
        return f"{street} {number}{r.choice((', ', ' in ') if zip5 else (', ',))}{zip5}{town.split()[0] if r.random() < 0.7 else 'Neu-' + town.split()[0]}"
    if lang == "fr":
        street = f"{r.choice(('rue', 'quai', 'avenue', 'boulevard', 'impasse', 'place'))} {r.choice(('de ', 'des ', 'du ', 'du Vieux '))}{_word(r)}"
        return f"{number}{r.choice(('', ','))} {street}, {zip5}{r.choice((_word(r), f'Port-{_word(r)}', f'Saint-{_word(r)}-les-{_word(r)}'))}"
    street = f"{r.choice(('Calle', 'Plaza', 'Avenida', 'Camino', 'Paseo'))} {r.choice(('', 'de la ', 'de los ', 'del '))}{_word(r)}{r.choice(('', f' {_word(r)}'))}"
    return f"{street}{r.choice((' ', ', ', ' n.º '))}{number}, {zip5}{town}"


def sentence(r: random.Random, given: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    if r.random() < 0.45:
        text = r.choice(NEUTRAL)
        fill = {"c": lambda: _word(r), "C": lambda: _word(r).upper(), "d": lambda: r.choice("0123456789"), "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(8)), "h4": lambda: "".join(r.choice("0123456789abcdef") for _ in range(4)), "H": lambda: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))}
        text = re.sub(r"\{(\w+)\}", lambda m: fill[m[1]](), text)
        return (text.upper() if r.random() < 0.06 else text), []
    lang = r.choice(("en", "en", "de", "fr", "es"))
    out, gold = "", []
    name, last = _name(r, given)
    for piece in re.split(r"(\{\w\})", r.choice(CONTEXTS[lang])):
        start = len(out)
        if piece == "{n}":
            out += name
            gold.append((start, len(out), "name"))
        elif piece == "{e}":
            out += _email(r, last)
            gold.append((start, len(out), "email"))
        elif piece == "{p}":
            out += _signs(r, r.choice(PHONES[lang if r.random() < 0.9 else "en"]))
            gold.append((start, len(out), "phone"))
        elif piece == "{a}":
            out += _address(r, lang)
            gold.append((start, len(out), "address"))
        elif piece == "{i}":
            label, mark = re.match(r"(.*)\{(\w)\}", r.choice(LABELS[lang])).groups()
            out += label
            start = len(out)
            out += _signs(r, r.choice(SIGNS[mark]))
            gold.append((start, len(out), "id"))
        else:
            out += piece
    return out, gold


def labelled_texts(given: list[str], n: int, seed: int = 5) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """n short documents of a few sentences with their values' places."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randrange(2, 5)):
            if text:
                text += r.choice((" ", " ", "\n", "\n\n"))
            s, places = sentence(r, given)
            gold |= {(a + len(text), b + len(text), t) for a, b, t in places}
            text += s
        out.append((text, gold))
    return out


@lru_cache(4)
def _trained(given: tuple[str, ...], texts: int) -> SpanModel:
    return SpanModel(given).fit(labelled_texts(list(given), texts))


def trained_model(given_names: list[str | None], texts: int = 2500) -> SpanModel:
    """A model trained on composed texts; once per process and list of names."""
    return _trained(tuple(sorted({g for g in given_names if g})), texts)
