"""Personal data: fixed patterns, and further spans by weak supervision.

Labelers vote on candidate spans: patterns look at the span itself, gazetteers at
its words, context labelers at the words around it. How reliable each labeler is
comes out of their agreement alone, by expectation-maximisation over the counts of
vote patterns. The posteriors then train the classifier that decides on a span.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import Staging, texts_of

Batches = Iterator[pa.RecordBatch]

#: Fixed values of the contract: kinds in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends inside a run of digits, so it can only begin where one begins.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Spans the method may add. Their kinds differ from the fixed ones.
ADDED_KINDS = ("account", "date_of_birth", "handle", "name", "national_id", "secret")
#: Capitalised words of any alphabet with case, also with hyphens, and with marks written apart.
UPPER = "".join(c for c in map(chr, range(1 << 16)) if c.isupper() and c.isalpha())
#: The others are rare: one range around them, which is quicker to match, and then a look at the letter.
BEYOND = f"\U00010000-{chr(sys.maxunicode)}"
_LETTER, _MARKS = "[^\\W\\d_]", "[\u0300-\u036f]*"
_UP, _LOW = f"[{UPPER}{BEYOND}]{_MARKS}", f"(?:[^\\W\\d_{UPPER}]{_MARKS})"
_PART = f"{_UP}(?:['\u2019]{_UP})?{_LOW}+(?:{_UP}{_LOW}+)*"
_NAME = f"{_PART}(?:-{_PART})*"
_NAME_END = f"(?!{_LETTER}|[-'\u2019]{_LETTER})"
ONE_WORD = re.compile(_NAME + _NAME_END)
TWO_WORDS = re.compile(f"{_NAME} {_NAME}{_NAME_END}")
TITLES = frozenset("mr mrs ms dr prof herr frau señor señora monsieur madame sr sra m mme".split())
_TITLES = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))
TITLED = re.compile(f"(?<!{_LETTER})(?i:{_TITLES})\\.? \\Z")
#: What a candidate looks like: the widest reading, of which the labelers judge each.
CANDIDATES = {
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:(?i:passw(?:or)?d|pwd|api[_-]?key|token|secret)[ ]?[=:][ ]?[\"']?[^\s,;\"']{6,}|[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9]))"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![0-9.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "date_of_birth": re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])"),
    "handle": re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@.-])"),
    # Where a capitalised word starts.
    "name": re.compile(f"[{UPPER}{BEYOND}](?<!{_LETTER}.)(?<!{_LETTER}[-'\u2019\u0300-\u036f].)"),
}


def _folded(word: str) -> str:
    """Without accents, however they are written."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


#: Frequent first names and surnames of several languages and scripts.
FIRST_NAMES = frozenset(
    "Ahmed Aisha Alejandro Alexander Ali Alice Amelia Amir Ana Andrea Andreas Andrew Anna Anne "
    "Antonio Barbara Beatriz Ben Benjamin Bob Brian Camille Carlos Carmen Caroline Catherine Charles "
    "Charlotte Chloé Chris Christian Christine Claire Claudia Daniel David Deborah Diego Dmitri "
    "Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Fernando Francesca Francesco "
    "François Frank George Giovanni Giulia Grace Greta Hannah Hans Hassan Heinrich Helen Henry "
    "Hiroshi Ibrahim Ines Ingrid Isabel Isabelle Ivan Jack Jacob Jacques James Jan Jane Javier Jean "
    "Jennifer Jessica John Jorge José Joseph Juan Julia Julie Jürgen Karen Karl Katarina Katherine Kevin Klaus "
    "Laura Lena Leon Linda Lisa Louis Luca Lucas Lucía Luis Manuel Marco Margaret Maria Marie Mario "
    "Mark Markus Marta Martin Mary Matthew Mehmet Michael Michel Miguel Mohamed Mohammed Monika Nadia "
    "Nancy Natalia Nicolas Nina Olga Olivia Omar Pablo Patricia Paul Pedro Peter Petra Philip Pierre "
    "Priya Rachel Rafael Raj Ravi Rebecca Ricardo Richard Robert Rosa Samuel Sandra Sarah Sergei "
    "Sofia Sophie Stefan Stephen Susan Svetlana Teresa Thomas Tom Ursula Wei William Wolfgang Yuki "
    "Yusuf Анна Иван Мария Ольга Сергей Γιώργος Ελένη Μαρία".split()
)
SURNAMES = frozenset(
    "Adams Ahmed Ali Allen Álvarez Anderson Andersson Bailey Baker Bauer Becker Bennett Bernard "
    "Bianchi Brown Campbell Carter Castro Chen Clark Collins Cooper Costa Cruz Davies Davis Díaz "
    "Dubois Durand Edwards Esposito Evans Fernandes Fernández Ferrari Ferreira Fischer Flores Fontaine "
    "García Garnier Gómez González Gonzalez Gray Gupta Gutiérrez Hall Hansen Harris Hernández Hoffmann Horvat "
    "Hughes Hussain Ivanov Ivanova Jackson Jansen Jensen Jiménez Johansson Johnson Jones Kaya Keller Khan Kim "
    "Klein Koch Kowalski Krüger Kumar Lambert Larsen Laurent Lee Lefebvre Leroy Lewis Li Liu López "
    "Martin Martínez Mehta Meyer Miller Mitchell Moore Morales Moreau Moreno Müller Muñoz Murphy "
    "Nakamura Nelson Neumann Nguyen Nielsen Novak Nowak Oliveira Ortiz Özdemir Papadopoulos Parker "
    "Patel Pereira Pérez Petit Petrov Petrova Phillips Popov Ramírez Ramos Reyes Ricci Richter Rivera "
    "Roberts Robinson Rodríguez Romano Romero Rossi Roux Ruiz Russo Sánchez Santos Sato Schäfer Schmidt Schmitt "
    "Schneider Schröder Schulz Schwarz Scott Silva Singh Smirnov Smith Suzuki Svensson Tanaka Taylor "
    "Thompson Torres Tran Turner Vargas Vega Vogel Wagner Walker Wang Watanabe Watson Weber Weiß Williams "
    "Wilson Wolf Wright Yamamoto Yılmaz Zhang Zimmermann Иванов Иванова Петров Петрова Смирнов "
    "Παπαδόπουλος".split()
)
FOLDED_FIRST_NAMES = frozenset(map(_folded, FIRST_NAMES))
FOLDED_SURNAMES = frozenset(map(_folded, SURNAMES))
CUES = {
    "secret": frozenset("password passwd key secret token credentials login access aws".split()),
    "account": frozenset("iban account bank konto cuenta compte transfer pay".split()),
    "national_id": frozenset("ssn social security id passport identity ausweis dni".split()),
    "date_of_birth": frozenset("born birth birthday dob geboren né née nacido nacida".split()),
    "handle": frozenset("twitter follow contact instagram user username profile".split()),
    "name": frozenset("name contact dear sincerely regards author signed".split()) | TITLES,
}
AGAINST = frozenset("example sample version chapter figure table section page isbn volume".split())
WORD = re.compile(r"[^\W_]+")
#: Letters before and after a span that its context labelers read.
WINDOW = 48
YES, NO, SILENT = 1, 0, 2
VOTERS = 6
#: Rates of the votes NO, YES and SILENT by truth that the labelers start with: first the general
#: ones, then those of cues behind a span, and of words against it. Silence of these says little.
START = np.array([[[0.3, 0.05, 0.65], [0.05, 0.45, 0.5]]] * VOTERS)
START[3] = [[0.02, 0.03, 0.95], [0.02, 0.13, 0.85]]
START[4] = [[0.10, 0.02, 0.88], [0.05, 0.02, 0.93]]
#: The surname labeler speaks on names alone.
SURNAME = 5
#: All patterns of votes, and how much the classifier heeds one that the texts do not show.
PATTERNS = np.stack(np.meshgrid(*[(NO, YES, SILENT)] * VOTERS, indexing="ij"), -1).reshape(-1, VOTERS)
UNSEEN = 1.0


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    numbers = [int(d) for d in reversed(digits)]
    return (sum(numbers[::2]) + sum(doubled[d] for d in numbers[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Goes from one @ to the next, so that a long run of letters is read once.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed kinds, by start and kind; code points, end exclusive."""
    found = [("email", *span) for span in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(int(part) <= 255 for part in m[0].split(".") if len(part.lstrip("0")) < 4) and all(
                len(part.lstrip("0")) < 4 for part in m[0].split(".")
            ):
                found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _plausible(kind: str, span: str) -> int:
    """Whether the span itself is well formed beyond the candidate's pattern."""
    if kind == "secret":
        value = re.split("[=:]", span, maxsplit=1)[-1].strip(" \"'")
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        return YES if mixed else NO
    if kind == "account":
        packed = span.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4]))
        return YES if number % 97 == 1 else NO
    if kind == "national_id":
        area, group, serial = span.split("-")
        fine = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        return YES if fine else NO
    if kind == "date_of_birth":
        year = int(max(re.split("[./-]", span), key=len))
        return SILENT if 1900 <= year <= 2020 else NO
    if kind == "handle":
        return YES if any(c.islower() for c in span) else SILENT
    return SILENT


def _titled(text: str, start: int) -> bool:
    return text[start - 1 : start] == " " and TITLED.search(text, max(0, start - 16), start) is not None


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler on a candidate."""
    span = text[start:end]
    before = [w.lower() for w in WORD.findall(text[max(0, start - WINDOW) : start])][-5:]
    after = [w.lower() for w in WORD.findall(text[end : end + WINDOW])][:3]
    inside = WORD.findall(_folded(span) if kind == "name" else span)
    gazetteer = surname = SILENT
    # After a title stands a name, be it a first name or a surname.
    titled = kind == "name" and _titled(text, start)
    if kind == "name":
        # No list holds all names, so one that is not on it is no vote against.
        if inside[0] in FOLDED_FIRST_NAMES:
            gazetteer = YES
        elif inside[0].lower() in CUES["name"]:  # the word before a name is none
            gazetteer = NO
        surname = YES if inside[-1] in FOLDED_SURNAMES else SILENT
    elif kind == "secret":
        known = any(w.lower() in CUES["secret"] for w in inside) or span.startswith("AKIA")
        gazetteer = YES if known else NO
    else:  # "born 12.03.1980": the words right before say what it is
        gazetteer = YES if any(w in CUES[kind] for w in before[-2:]) else SILENT
    near = any(w in CUES[kind] for w in before)
    return (
        YES if titled else _plausible(kind, span),
        gazetteer,
        YES if near else SILENT,
        YES if any(w in CUES[kind] for w in after) else SILENT,
        NO if AGAINST.intersection(before + after) else SILENT,
        surname,
    )


def shape(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Features of the classifier beside the votes."""
    span = text[start:end]
    sentence_start = start == 0 or text[max(0, start - 2) : start].strip()[-1:] in ("", ".", "!", "?", "\n")
    return (
        ADDED_KINDS.index(kind),
        min(7, (end - start) // 6),
        int(any(c.isdigit() for c in span)),
        int(sentence_start),
    )


def _places(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of the candidates of a kind, by start.

    A name is each two capitalised words side by side, so these may overlap, or one after a
    title, which is no part of it.
    """
    pattern = CANDIDATES[kind]
    if kind != "name":
        yield from (m.span() for m in pattern.finditer(text))
        return
    for m in pattern.finditer(text):
        start = m.start()
        if not m[0].isupper():
            continue
        two = TWO_WORDS.match(text, start)
        if two and two[0].split(" ")[0].lower() not in TITLES:
            yield two.span()
        elif _titled(text, start) and (one := ONE_WORD.match(text, start)):
            yield one.span()


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans, and candidates outside them with their votes and shape as a key."""
    base = base_spans(text)
    taken = sorted((start, end) for _, start, end in base)
    candidates = []
    for kind in CANDIDATES:
        i = 0
        for start, end in _places(kind, text):
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if i < len(taken) and taken[i][0] < end:
                continue
            key = votes(kind, text, start, end) + shape(kind, text, start, end)
            candidates.append((kind, start, end, ",".join(map(str, key))))
    return base, candidates


@dataclass(frozen=True)
class SpanModel:
    """What the labelers turned out to be worth, and the classifier's verdict on each key."""

    reliability: dict[str, np.ndarray]
    weights: np.ndarray
    bias: float

    def probability(self, keys: np.ndarray) -> np.ndarray:
        z = encode_keys(keys) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def encode_keys(keys: np.ndarray) -> np.ndarray:
    """Columns of each kind for itself: its votes for and against, length class and marks."""
    votes_, kind, rest = keys[:, :VOTERS], keys[:, VOTERS], keys[:, VOTERS + 1 :]
    told = [np.ones((len(keys), 1), bool), votes_ == YES, votes_ == NO]
    told += [rest[:, :1] == np.arange(8), rest[:, 1:] == 1]
    facts = np.concatenate(told, axis=1)
    columns = [facts & (kind == k)[:, None] for k in range(len(ADDED_KINDS))]
    return np.concatenate(columns, axis=1).astype(float)


def expectation_maximisation(
    votes_: np.ndarray,
    counts: np.ndarray,
    prior: float = 0.1,
    rounds: int = 100,
    start: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and each labeler's rates of votes by truth.

    ``votes_`` has a row for each pattern, ``counts`` how often it occurs. Votes are
    taken as independent given the truth; rates start in favour of the labelers and
    are smoothed, so a labeler that seldom votes stays believed. Where true spans are
    rare, their share does not fall below that of the spans with two votes for and none
    against. A pattern that does not occur has a count of 0 and gets its posterior too.
    """
    patterns, voters = votes_.shape
    onehot = np.stack([votes_ == v for v in (NO, YES, SILENT)], axis=2).astype(float)
    if start is None:
        start = np.repeat(START[:1], voters, axis=0)  # voter, truth, vote
    # A cue is rare by nature: silence says little.
    smoothing = 50.0 * start
    rates = start.copy()
    share = prior
    agreed = ((votes_ == YES).sum(axis=1) > 1) & ~(votes_ == NO).any(axis=1)
    least = max(0.01, float(counts @ agreed) / max(1.0, float(counts.sum())))
    posterior = np.full(patterns, prior)
    for _ in range(rounds):
        told = np.einsum("pvx,vtx->pt", onehot, np.log(rates))
        gap = told[:, 1] - told[:, 0] + np.log(share / (1 - share))
        last, posterior = posterior, 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        for truth, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            seen = np.einsum("p,pvx->vx", weight, onehot) + smoothing[:, truth]
            rates[:, truth] = seen / seen.sum(axis=1, keepdims=True)
        total = counts.sum()
        share = float(np.clip((counts @ posterior + 5 * prior) / (total + 5), min(least, 0.99), 0.99))
        if np.abs(posterior - last).max() < 1e-9:
            break
    return posterior, rates


def train(keys: list[str], counts: list[int], rounds: int = 100) -> SpanModel:
    """The span classifier from counts of keys: one EM for each kind, then one logistic fit.

    Patterns of votes that the texts do not show are learned with a small weight from
    what the EM holds of them, so texts without a name do not teach that there is none.
    """
    table = np.array([[int(x) for x in k.split(",")] for k in keys], int).reshape(-1, VOTERS + 4)
    pattern = table[:, :VOTERS] @ 3 ** np.arange(VOTERS - 1, -1, -1)
    number = np.argsort(PATTERNS @ 3 ** np.arange(VOTERS - 1, -1, -1))
    n = np.array(counts, float)
    soft = np.zeros(len(table))
    reliability, unseen, believed = {}, [], []
    for k, kind in enumerate(ADDED_KINDS):
        own = np.flatnonzero(table[:, VOTERS] == k)
        where = number[pattern[own]]
        total = np.bincount(where, n[own], len(PATTERNS))
        start = START.copy()
        if kind != "name":
            start[SURNAME] = 1 / 3
        posterior, reliability[kind] = expectation_maximisation(PATTERNS, total, start=start)
        soft[own] = posterior[where]
        rest = np.flatnonzero(total == 0)
        shapeless = np.tile([k, -1, 0, 0], (len(rest), 1))
        unseen.append(np.c_[PATTERNS[rest], shapeless])
        believed.append(posterior[rest])
    table = np.concatenate([table, *unseen])
    x = np.c_[encode_keys(table), np.ones(len(table))]
    # A key that fills the corpus should not drown the others.
    n = np.r_[np.sqrt(n), np.full(len(table) - len(n), UNSEEN)]
    soft = np.concatenate([soft, *believed])
    theta = np.zeros(x.shape[1])
    penalty = 0.1 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (n * (soft - p)) - penalty @ theta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        theta += step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(reliability, theta[:-1], float(theta[-1]))


SPAN = "struct<kind:string,start:int,stop:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, candidates`` of every whole text, in one pass."""
    schema = (
        f"doc_id long, base array<{SPAN}>, "
        "candidates array<struct<kind:string,start:int,stop:int,key:string>>"
    )

    def scanned(batches: Batches) -> Batches:
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _structs([b for b, _ in found]), _structs([c for _, c in found], 4)],
                ["doc_id", "base", "candidates"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(scanned, schema)


def _structs(rows: list[list[tuple]], width: int = 3) -> pa.Array:
    names = ("kind", "start", "stop", "key")
    types = (pa.string(), pa.int32(), pa.int32(), pa.string())
    kind = pa.list_(pa.struct(list(zip(names, types, strict=True))[:width]))
    return pa.array([[dict(zip(names, r, strict=False)) for r in row] for row in rows], kind)


def learn_spans(scanned: DataFrame) -> SpanModel:
    """The classifier from the candidates of all documents.

    The driver sees one count for each key: votes, kind and shape, of which there are
    a bounded number, however many documents there are.
    """
    keys = scanned.select(F.explode("candidates.key").alias("key")).groupBy("key").count().collect()
    keys = sorted((r["key"], r["count"]) for r in keys)
    return train([k for k, _ in keys], [c for _, c in keys])


def find_spans(
    docs: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, base, spans``: the fixed kinds' spans, and all spans, by start and kind.

    Candidates that the classifier holds for personal data with at least the
    threshold are added; they never overlap a base span. Every two capitalised words
    side by side are a candidate for a name, and likely ones that overlap are one name.
    Spans count code points,
    their end is exclusive.

    Null text is empty and has no spans. Rows without id and repeated rows are
    searched like any other. An empty table gives an empty result.
    """
    staging = Staging(docs.sparkSession, "personal")
    scanned = staging.keep(scan(docs, id_col, text_col))
    model = learn_spans(scanned)
    schema = f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>"
    return staging.finish(scanned.mapInArrow(_decided(model, threshold), schema))


class _Likely:
    """The spans of a text by the model, each key judged once."""

    def __init__(self, model: SpanModel, threshold: float) -> None:
        self._model = model
        self._threshold = threshold
        self._known: dict[str, bool] = {}
        self._order = {kind: i for i, kind in enumerate((*KINDS, *ADDED_KINDS))}

    def _judge(self, key: str) -> bool:
        if key not in self._known:
            table = np.array([[int(x) for x in key.split(",")]])
            self._known[key] = bool(self._model.probability(table)[0] >= self._threshold)
        return self._known[key]

    def spans(self, base: list[dict], candidates: list[dict]) -> list[tuple[str, int, int]]:
        likely = [c for c in candidates if self._judge(c["key"])]
        spans = [(s["kind"], s["start"], s["stop"]) for s in (*base, *likely) if s["kind"] != "name"]
        names: list[tuple[str, int, int]] = []
        for s in (s for s in likely if s["kind"] == "name"):
            if names and s["start"] < names[-1][2]:  # two readings of one longer name
                names[-1] = ("name", names[-1][1], max(names[-1][2], s["stop"]))
            else:
                names.append(("name", s["start"], s["stop"]))
        spans += names
        return sorted(spans, key=lambda s: (s[1], self._order[s[0]]))


def _decided(model: SpanModel, threshold: float) -> Callable[[Batches], Batches]:
    def decided(batches: Batches) -> Batches:
        likely = _Likely(model, threshold)
        for batch in batches:
            pairs = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            spans = _structs([likely.spans(*pair) for pair in pairs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), spans], ["doc_id", "base", "spans"]
            )

    return decided


def mask(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets, such as ``[EMAIL]``.

    Other columns stay, but for ``n_chars``, which is counted anew. Spans that overlap
    are replaced as one, by the kind of the first. Null text stays null.
    """
    staging = Staging(docs.sparkSession, "masking")
    place, found = docs.columns.index(text_col), f"{text_col}_candidates"
    while found in docs.columns:
        found += "_"
    kind = "struct<base:array<{0}>,candidates:array<{1}>>".format(SPAN, SPAN[:-1] + ",key:string>")
    schema = docs.withColumn(found, F.lit(None).cast(kind)).schema

    def scanned(batches: Batches) -> Batches:
        for batch in batches:
            spans = [find(t or "") for t in batch.column(place).to_pylist()]
            parts = [_structs([s[0] for s in spans]), _structs([s[1] for s in spans], 4)]
            column = pa.StructArray.from_arrays(parts, ["base", "candidates"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema.names)

    kept = staging.keep(docs.mapInArrow(scanned, schema))
    model = learn_spans(kept.select(F.col(f"{found}.candidates").alias("candidates")))

    def masked(batches: Batches) -> Batches:
        likely = _Likely(model, threshold)
        for batch in batches:
            texts = []
            spans = batch.column(len(schema.names) - 1).to_pylist()
            for text, row in zip(batch.column(place).to_pylist(), spans, strict=True):
                texts.append(text if text is None else blotted(text, likely.spans(row["base"], row["candidates"])))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names[:-1])

    result = kept.mapInArrow(masked, docs.schema)
    if "n_chars" in docs.columns:
        counted = F.length(text_col).cast(docs.schema["n_chars"].dataType)
        result = result.withColumn("n_chars", counted)
    return result


def blotted(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, free = [], 0
    for kind, start, stop in spans:
        if start >= free:
            parts += [text[free:start], f"[{kind.upper()}]"]
        free = max(free, stop)
    return "".join([*parts, text[free:]])
