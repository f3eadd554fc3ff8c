"""Personal data by weak supervision.

Candidates are spans that look like an email address, an IP address, a payment
card or a phone number: the base patterns' matches, and looser shapes (spelled-out
addresses, number groups without a country code, digit runs that fail a check).
Four labelers vote +1, -1 or 0 (no opinion) on each:

  pattern    the base pattern and its check hold, or fail
  gazetteer  a known top-level domain, card issuer prefix, calling code or
             reserved network
  context    a cue word shortly before the span
  shape      how the span is grouped

Votes of the whole corpus are counted by vote vector and feature, a table whose
size is bounded by the numbers of vectors (4 * 3**4) and feature buckets. On it
expectation-maximisation estimates each labeler's reliability by kind, and its
posteriors train the final span classifier, naive Bayes on hashed features.
Base spans always stay; the classifier's posterior alone decides which of the other
candidates join them, against a threshold by kind that is calibrated on all of these:
the best expected number of right decisions, where a candidate that fails its check
counts as wrong and the labelers' posterior tells the chance of any other. A candidate
that overlaps a base span is dropped.

Edge cases: null and empty texts have no spans; texts are scanned whole; repeated
rows are scanned row by row; an empty table gives an empty result and a model
without evidence that adds nothing; further columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C

KINDS = ("email", "ip", "card", "phone")
BUCKETS = 64
BINS, BIN = 320, 0.25

# Cue words, gazetteers.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "kontakt", "schreib"),
    "ip": ("ip", "address", "host", "server", "login", "from", "dirección", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "rufen"),
}
COUNTER_CUES = ("isbn", "order", "invoice", "version", "serial", "article", "section", "chapter", "commande", "bestellung", "pedido", "release")
DOMAINS = tuple(
    "com org net edu gov mil int io info biz name pro dev app ai co me tv cc xyz online site store tech cloud blog eu uk de fr es it pt nl be lu ch at ie dk se no fi is pl cz sk hu ro bg gr hr si rs ua ru tr il "
    "us ca mx br ar cl pe ve au nz cn jp kr in id my sg th vn ph hk tw za eg ng ke ma example invalid test localhost".split()
)
ISSUERS = (
    "4", "51", "52", "53", "54", "55", "2221", "223", "224", "225", "226", "23", "24", "25", "26", "270", "271", "2720", "34", "37", "300", "301", "302", "303", "304", "305", "36", "38", "39",
    "6011", "622", "64", "65", "3528", "353", "354", "355", "356", "357", "358", "50", "56", "57", "58", "60", "62", "63", "67", "81",
)
CALLING = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 223 225 226 227 228 229 230 231 233 234 237 "
    "243 244 248 249 250 251 252 254 255 256 258 260 261 263 264 265 267 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 500 501 502 503 504 505 "
    "506 507 509 591 592 593 595 597 598 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
RESERVED = ("0.", "10.", "127.", "169.254.", "172.16.", "192.0.2.", "192.168.", "198.18.", "198.51.100.", "203.0.113.", *(f"{k}." for k in range(224, 256)))

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DIGITS = re.compile(r"[0-9](?:[ .-]?[0-9])++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED = re.compile(r"\b([A-Za-z0-9._%+-]{1,64}) ?[\[({] ?at ?[\])}] ?([A-Za-z0-9-]{1,64}(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{1,64}){1,4})", re.I)
SPELLED_AT = re.compile(r"[\[({] ?at ?[\])}]", re.I)
PLAIN_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Each email holds one @, so matches are sought around each in turn."""
    floor, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > floor:  # the run of local characters, in pieces of 256
            piece = max(floor, low - 256)
            run = LOCAL.search(text, piece, low)
            if not run:
                break
            low = run.start()
            if low > piece:
                break
        if low < at and (m := DOMAIN.match(text, at + 1)):
            yield low, m.end(), True
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def numbers(text: str, chains: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, bool]]:
    """IP addresses and cards in runs of digits, right or failing their check."""
    for a, b in chains:
        body = text[a:b]
        if body.count(".") >= 3:
            for m in DOTTED.finditer(body):
                parts, at = m.group().split("."), a + m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    yield "ip", at, end, all(map(small, four))
                    at = end + 1
        if b - a >= 12:
            for m in CARD.finditer(body):
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19:
                    yield "card", a + m.start(), a + m.end(), luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield *m.span(), 9 <= sum(map(str.isdigit, m.group())) <= 15


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the base pattern and its check hold), by start."""
    chains = [m.span() for m in DIGITS.finditer(text) if m.end() - m.start() >= 7]
    found = list(numbers(text, chains))
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if "+" in text:
        found += [("phone", *x) for x in phones(text)]
    loose = []
    if SPELLED_AT.search(text):
        loose += [("email", *m.span(), False) for m in SPELLED.finditer(text)]
    loose += [("phone", *m.span(), False) for m in PLAIN_PHONE.finditer(text)] if chains else []
    sure = Taken(sorted((s, e) for _, s, e, ok in found if ok))
    return sorted([x for x in found if x[3]] + [x for x in found + loose if not x[3] and not sure.overlap(x[1], x[2])], key=lambda x: (x[1], KINDS.index(x[0])))


class Taken:
    """Sorted spans, asked for overlap by binary search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts = [s for s, _ in spans]
        self.reach = list(itertools.accumulate((e for _, e in spans), max))

    def overlap(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)  # those before k start before the end
        return k > 0 and self.reach[k - 1] > start


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    body = text[start:end]
    digits = re.sub(r"[^0-9]", "", body)
    loose_email = kind == "email" and not base
    pattern = 1 if base else 0 if loose_email or kind == "phone" and not body.startswith("+") else -1
    if kind == "email":
        gazetteer = 1 if re.split(r"[^a-z0-9-]+", body.lower())[-1] in DOMAINS else -1 if loose_email else 0
        shape = 1 if base or body.count("(") == body.count(")") and ". " not in body else -1
    elif kind == "ip":
        gazetteer = -1 if body.startswith(RESERVED) else 0
        shape = 1 if 7 <= len(body) <= 15 else -1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", body) else -1
    else:
        gazetteer = (1 if digits.startswith(CALLING) else -1) if body.startswith("+") else 0
        shape = 1 if re.search(r"[ ().-]", body) else 0
    before = {w.lower() for w in WORD.findall(text[max(0, start - 40) : start])}
    context = 1 if before & set(CUES[kind]) else -1 if before & set(COUNTER_CUES) else 0
    return pattern, gazetteer, context, shape


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """One bucket for each feature slot."""
    body = text[start:end]
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"{min(len(m.group()), 9)}", body))
    before = WORD.findall(text[max(0, start - 40) : start])
    after = text[end : end + 1]
    slots = (shape[:24], f"{min((end - start) // 4, 10)}", before[-1].lower() if before else "", "line" if start == 0 or text[start - 1] == "\n" else text[start - 1], after or "end", body[:1] if kind != "email" else body.lower()[-3:])
    return [k * BUCKETS + zlib.crc32(f"{kind}|{x}".encode()) % BUCKETS for k, x in enumerate(slots)]


def expectation_maximisation(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes); labelers are independent given the truth.

    The start has every labeler right four times in five, and one pseudo-count
    of that keeps a labeler that never votes where it began."""
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in KINDS:
        table = [(v, n) for (k, v), n in counts.items() if k == kind]
        prior = 0.5
        start = {1: {1: 0.55, 0: 0.35, -1: 0.10}, 0: {1: 0.10, 0: 0.35, -1: 0.55}}
        chance = [{y: dict(p) for y, p in start.items()} for _ in range(4)]
        for _ in range(rounds):
            p = {}
            for v, _ in table:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[i][1][x] / chance[i][0][x]) for i, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            total = sum(n for _, n in table)
            prior = min(0.999, max(0.001, (sum(n * p[v] for v, n in table) + 1) / (total + 2)))
            for i in range(4):
                for y in (1, 0):
                    mass = {x: 20 * start[y][x] for x in (1, 0, -1)}
                    for v, n in table:
                        mass[v[i]] += n * (p[v] if y else 1 - p[v])
                    whole = sum(mass.values())
                    chance[i][y] = {x: m / whole for x, m in mass.items()}
        posterior |= {(kind, v): p[v] for v, _ in table} if table else {}
    return posterior


class SpanClassifier:
    """Naive Bayes on hashed features, trained by posteriors."""

    def __init__(self, counts: dict[tuple[str, tuple[int, ...], int], int], posterior: dict) -> None:
        mass: dict = defaultdict(lambda: [0.5, 0.5])
        total: dict = defaultdict(lambda: [1.0, 1.0])
        for (kind, v, slot), n in counts.items():
            p = posterior[kind, v]
            for key, table in (((kind, slot), mass), ((kind, slot // BUCKETS), total)):
                table[key][1] += n * p
                table[key][0] += n * (1 - p)
        self.weight = {k: math.log(m[1] / (total[k[0], k[1] // BUCKETS][1] + BUCKETS / 2)) - math.log(m[0] / (total[k[0], k[1] // BUCKETS][0] + BUCKETS / 2)) for k, m in mass.items()}
        self.prior = {kind: math.log(total[kind, 0][1] / total[kind, 0][0]) for kind in KINDS if (kind, 0) in total}
        self.posterior = dict(posterior)
        self.threshold = dict.fromkeys(KINDS, 0.0)

    def odds(self, kind: str, slots: list[int]) -> float:
        """Log-odds that the span is of its kind."""
        return self.prior[kind] + sum(self.weight.get((kind, s), 0.0) for s in slots)

    def accepts(self, kind: str, slots: list[int]) -> bool:
        return kind in self.prior and self.odds(kind, slots) >= self.threshold[kind]

    def calibrate(self, counts: dict[tuple[str, tuple[int, ...], int], int]) -> None:
        """counts: candidates beside the base spans by kind, votes and bin of the odds."""
        for kind in KINDS:
            gain = [0.0] * (BINS + 1)
            for (k, v, slot), n in sorted(counts.items()):
                if k == kind:
                    gain[slot] += n * ((0.0 if v[0] < 0 else self.posterior[k, v]) - 0.5)
            best, total = (0.0, BINS), 0.0
            for slot in range(BINS - 1, -1, -1):
                total += gain[slot]
                best = max(best, (total, slot))
            self.threshold[kind] = -math.inf if best[1] == 0 else math.inf if best[1] == BINS else (best[1] - BINS // 2) * BIN


def train(docs: DataFrame) -> SpanClassifier:
    """Count votes and features over all texts, then fit the model on the counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for kind, s, e, base in candidates(text) if text else ():
                    v = ",".join(map(str, votes(text, kind, s, e, base)))
                    for slot in features(text, kind, s, e):
                        seen[kind, v, slot] += 1
        kind, v, slot = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(v, pa.string()), pa.array(slot, pa.int32()), pa.array(seen.values(), pa.int64())], ["kind", "v", "slot", "n"])

    counted = docs.select("text").mapInArrow(work, "kind string, v string, slot int, n long").groupBy("kind", "v", "slot").agg(F.sum("n").alias("n"))
    counts = {(r.kind, tuple(map(int, r.v.split(","))), r.slot): r.n for r in sorted(counted.collect())}  # at most 4 * 81 * 6 * BUCKETS rows
    patterns: dict = defaultdict(int)
    for (kind, v, slot), n in counts.items():
        if slot < BUCKETS:
            patterns[kind, v] += n
    model = SpanClassifier(counts, expectation_maximisation(patterns))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for kind, s, e, base in candidates(text) if text else ():
                    if not base:
                        odds = math.floor(model.odds(kind, features(text, kind, s, e)) / BIN) + BINS // 2
                        seen[kind, ",".join(map(str, votes(text, kind, s, e, base))), max(0, min(BINS - 1, odds))] += 1
        kind, v, slot = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(v, pa.string()), pa.array(slot, pa.int32()), pa.array(seen.values(), pa.int64())], ["kind", "v", "slot", "n"])

    placed = docs.select("text").mapInArrow(place, "kind string, v string, slot int, n long").groupBy("kind", "v", "slot").agg(F.sum("n").alias("n"))
    model.calibrate({(r.kind, tuple(map(int, r.v.split(","))), r.slot): r.n for r in placed.collect()})  # at most 4 * 81 * BINS rows
    return model


def spans(text: str | None, model: SpanClassifier) -> tuple[list, list]:
    """Base spans, and all spans with those that the model adds; both by start and kind."""
    base, more, end = [], [], -1
    for kind, s, e, ok in candidates(text) if text else ():
        if ok:
            base.append((kind, s, e))
            more.append((kind, s, e))
        elif s >= end and model.accepts(kind, features(text, kind, s, e)):
            more.append((kind, s, e))
            end = e
    return base, more


def joined(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_pii(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans of each whole text."""
    model = model or train(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [[] for _ in KINDS], [], []
            for value in batch.column(1):
                base, every = spans(value.as_py(), model)
                for column, kind in zip(counts, KINDS, strict=True):
                    column.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str | None, model: SpanClassifier) -> str | None:
    """text with each span replaced by its kind; of overlapping spans the whole stretch."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in spans(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact_pii(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """docs with the spans in text replaced by [EMAIL], [IP], [CARD] or [PHONE]."""
    model, place = model or train(docs), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(v.as_py(), model) for v in batch.column(place)], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return C.in_place(docs, work)
