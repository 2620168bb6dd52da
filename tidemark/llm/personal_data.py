"""Personal data: fixed patterns, and spans added by a semi-Markov conditional random field.

The patterns give the base spans, found in time linear in the text.  The field
works on zones: runs of tokens that hold a digit or an at sign.  It scores whole
candidate segments of up to ``MAX_TOKENS`` tokens (shape, digits, check digit,
punctuation, the word before), and dynamic programming over these bounded
segments chooses boundaries and types together.  It is trained on a bounded
sample of zones whose segments the patterns label, and on planted variants of
these zones: the same data with separators or prefixes that the patterns do not
know, and spoiled ones (a wrong check digit, a part beyond 255, too few digits)
that are no personal data.  Decoded segments that no base span overlaps are
added where their posterior is ``ACCEPT`` or more.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import hash_sample, in_slices, keyed_text, lean, rows, stored

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 5
#: Documents and zones that the field is trained on at most, chosen by hashes; steps of training; posterior that a span needs.
TRAIN_DOCS, TRAIN_ZONES, STEPS, ACCEPT = 8_000, 1_500, 12_000, 0.9

#: Planted variants, and as many spoiled ones, of each zone with data.
PLANTED = 3

#: Bytes of text that a task handles at a time.
SLICE_BYTES = 4 << 20

# Fixed patterns. The look-behinds and possessive repeats only skip starts that cannot match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_BETWEEN = re.compile(r"[^\w\s]+")
_EDGE = ".,;:!?\"'"

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and then start; a failing match is dropped and not tried again."""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- the field


def zones(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The word before each zone, and the places of its tokens without edge punctuation."""
    before, zone, word = "", [], ""
    for m in _TOKEN.finditer(text):
        token = m[0]
        if _HINT.search(token):
            if not zone:
                before = word
            lead = len(token) - len(token.lstrip(_EDGE))
            zone.append((m.start() + lead, max(m.start() + lead, m.start() + len(token.rstrip(_EDGE)))))
        else:
            if zone:
                yield before, zone
                zone = []
            word = token
    if zone:
        yield before, zone


def _features(segment: str, n_tokens: int, before: str) -> list[str]:
    digits = "".join(_DIGITS.findall(segment))
    n = len(digits)
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", segment))[:24]
    size = "0" if not n else "1-8" if n < 9 else "9-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20-"
    parts = _BETWEEN.split(segment)
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    return [
        "any", f"tokens={n_tokens}", f"shape={shape}", f"size={size}", f"check={13 <= n <= 19 and luhn(digits)}", f"size={size},check={luhn(digits) if n else False}",
        f"plus={segment[:1] == '+'}", f"at={segment.count('@')}", f"four={four}", f"letters={bool(re.search(r'[^\W\d_]', segment))}", f"before={before.lower()[-12:]}",
    ]


class SpanField:
    """Weights by feature and label (0: none, else a kind + 1) and by successive labels."""

    def __init__(self, weights: dict[str, list[float]] | None = None, follows: list[list[float]] | None = None):
        self.weights = weights if weights is not None else {}
        self.follows = follows or [[0.0] * 5 for _ in range(5)]

    def _segments(self, text: str, before: str, zone: list[tuple[int, int]]):
        """For each end and length: features and scores of the labels; only one token can be none."""
        out = []
        for j in range(1, len(zone) + 1):
            ends = []
            for n in range(1, min(MAX_TOKENS, j) + 1):
                features = _features(text[zone[j - n][0] : zone[j - 1][1]], n, before if j == n else "")
                scores = [0.0] * 5
                for f in features:
                    w = self.weights.get(f)
                    if w:
                        scores = [a + b for a, b in zip(scores, w)]
                if n > 1:
                    scores[0] = -math.inf
                ends.append((features, scores))
            out.append(ends)
        return out

    def posteriors(self, text: str, before: str, zone: list[tuple[int, int]]):
        """Segments, and for each end, length and label its posterior; also of successive labels."""
        segments, n = self._segments(text, before, zone), len(zone)
        ahead = [[0.0, *[-math.inf] * 4]] + [[-math.inf] * 5 for _ in range(n)]
        enter = [[-math.inf] * 5 for _ in range(n + 1)]  # before a segment with the label that begins here
        for j in range(n + 1):
            if j:
                for length, (_, scores) in enumerate(segments[j - 1], 1):
                    for y in range(5):
                        ahead[j][y] = _add(ahead[j][y], enter[j - length][y] + scores[y])
            for y in range(5):
                for x in range(5):
                    enter[j][y] = _add(enter[j][y], ahead[j][x] + self.follows[x][y])
        back = [[-math.inf] * 5 for _ in range(n)] + [[0.0] * 5]
        for j in range(n - 1, -1, -1):
            leave = [-math.inf] * 5  # with a segment of the label that begins here
            for length in range(1, min(MAX_TOKENS, n - j) + 1):
                scores = segments[j + length - 1][length - 1][1]
                for y in range(5):
                    leave[y] = _add(leave[y], scores[y] + back[j + length][y])
            for x in range(5):
                for y in range(5):
                    back[j][x] = _add(back[j][x], self.follows[x][y] + leave[y])
        total = back[0][0]
        found = [
            [[math.exp(min(0.0, enter[j - length][y] + scores[y] + back[j][y] - total)) for y in range(5)] for length, (_, scores) in enumerate(ends, 1)]
            for j, ends in enumerate(segments, 1)
        ]
        return segments, found

    def decode(self, text: str, before: str, zone: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """The best segmentation's typed segments: kind, start, end, posterior."""
        segments, posterior = self.posteriors(text, before, zone)
        n = len(zone)
        best = [[(0.0, 0, 0) if y == 0 else (-math.inf, 0, 0) for y in range(5)]] + [[(-math.inf, 0, 0)] * 5 for _ in range(n)]
        for j in range(1, n + 1):
            for length, (_, scores) in enumerate(segments[j - 1], 1):
                for y in range(5):
                    value, x = max((best[j - length][x][0] + self.follows[x][y], x) for x in range(5))
                    if value + scores[y] > best[j][y][0]:
                        best[j][y] = (value + scores[y], length, x)
        out, j = [], n
        y = max(range(5), key=lambda y: best[n][y][0])
        while j > 0:
            _, length, x = best[j][y]
            if y:
                out.append((y - 1, zone[j - length][0], zone[j - 1][1], posterior[j - 1][length - 1][y]))
            j, y = j - length, x
        return out[::-1]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _labelled(text: str, zone: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """The zone's segments by the base spans: length in tokens and label."""
    out, i = [], 0
    while i < len(zone):
        hit = next(((k, a, b) for k, a, b in spans if a < zone[i][1] and b > zone[i][0]), None)
        n = 1
        if hit:
            while i + n < len(zone) and n < MAX_TOKENS and zone[i + n][0] < hit[2]:
                n += 1
        out.append((n, hit[0] + 1 if hit else 0))
        i += n
    return out


def variant(kind: int, span: str, rng: random.Random) -> str:
    """A base span as the patterns do not know it: other separators, or a number without its plus."""
    if kind == 0:
        name, _, host = span.rpartition("@")
        at, dot = rng.choice([("[@]", "."), ("(@)", "."), ("@", "[.]"), ("@", "(.)"), ("[@]", "[.]"), ("(@)", "(.)")])
        return name + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", "(.)", "{.}"]))
    if kind == 2:
        digits = "".join(_DIGITS.findall(span))
        return rng.choice([".", "/", "_", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return rng.choice([span[1:], "00" + span[1:], "+" + re.sub(r"[^0-9]+", "/", span[1:])])


def spoiled(kind: int, span: str, rng: random.Random) -> str:
    """What looks like a variant and is no personal data."""
    if kind == 0:
        return "@" + span.rpartition("@")[0]
    other = variant(kind, span, rng)
    if kind == 1:
        return re.sub(r"^[0-9]+", str(rng.randint(256, 999)), other)
    if kind == 2:
        return other[:-1] + str((int(other[-1]) + rng.randint(1, 9)) % 10)
    digits = "".join(_DIGITS.findall(span))
    return f"{digits[-7:-4]}-{digits[-4:]}"


def planted(text: str, before: str, spans: list[Span], rng: random.Random, *, spoil: bool = False) -> list[tuple]:
    """Zones of ``text`` with each span in another form, and their segments: typed, or none where the data are spoiled."""
    out, last, typed = "", 0, []
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < last:
            continue
        out += text[last:a]
        new = (spoiled if spoil else variant)(k, text[a:b], rng)
        if not spoil:
            typed.append((k, len(out), len(out) + len(new)))
        out, last = out + new, b
    out += text[last:]
    found = [(before if n == 0 else word, zone) for n, (word, zone) in enumerate(zones(out))]
    return [(out, word, zone, _labelled(out, zone, typed)) for word, zone in found]


def _train(sample: list[tuple[str, str, list[tuple[int, int]], list[tuple[int, int]]]], rate: float = 0.2) -> SpanField:
    """Stochastic ascent of the labelled segmentations' likelihood, with adaptive rates."""
    field, seen = SpanField(), defaultdict(lambda: [1e-3] * 5)
    for _ in range(min(40, -(-STEPS // len(sample))) if sample else 0):
        for text, before, zone, gold in sample:
            segments, posterior = field.posteriors(text, before, zone)
            truth, j = set(), 0
            for n, y in gold:
                j += n
                truth.add((j, n, y))
            for j, ends in enumerate(segments, 1):
                for n, (features, _) in enumerate(ends, 1):
                    slope = [((j, n, y) in truth) - posterior[j - 1][n - 1][y] for y in range(5)]
                    if max(map(abs, slope)) < 1e-3:
                        continue
                    for f in features:
                        w, s = field.weights.setdefault(f, [0.0] * 5), seen[f]
                        for y in range(5):
                            s[y] += slope[y] * slope[y]
                            w[y] += rate * (slope[y] - 1e-4 * w[y]) / math.sqrt(s[y])
    return field


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> SpanField:
    """Train on at most ``TRAIN_ZONES`` zones of at most ``TRAIN_DOCS`` different texts of ``df``, and on planted variants of those.

    Null and empty texts have no zones, null ids do not matter, copies count
    once; without any zone, as in an empty table, nothing is ever added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            out = []
            for i, text in zip(ids, texts):
                if text and _HINT.search(text):
                    spans = base_spans(text)
                    for n, (before, zone) in enumerate(zones(text)):
                        if len(zone) <= 12:
                            a, b = zone[0][0], zone[-1][1]
                            gold = _labelled(text, zone, spans)
                            out.append((i, n, any(y for _, y in gold), text[a:b], before, [x - a for s in zone for x in s], [x for s in gold for x in s]))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["id", "n", "typed", "text", "before", "places", "gold"])

    schema = "id long, n int, typed boolean, text string, before string, places array<int>, gold array<int>"
    # texts are chosen by their hashes alone, so that no task gathers the sample's texts; copies count once
    hinted = keyed_text(df, id_col, text_col).where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("id"), "text")
    chosen = stored(hash_sample(hinted.select("id").distinct(), TRAIN_DOCS, "id"), "sampled-texts")  # at most TRAIN_DOCS numbers
    docs = hinted.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    found = stored(docs.mapInArrow(lambda batches: lean(run(batches)), schema), "zones")
    half = [hash_sample(found.where(c), TRAIN_ZONES // 2, "id", "n").collect() for c in ("typed", "NOT typed")]
    mixed = [r for pair in zip(*half) for r in pair] + [r for h in half for r in h[min(map(len, half)) :]]
    pairs = lambda x: list(zip(x[::2], x[1::2]))
    sample, rng = [], random.Random(len(mixed))
    for r in mixed:
        places, typed, i = pairs(r.places), [], 0
        for n, y in pairs(r.gold):
            if y:
                typed.append((y - 1, places[i][0], places[i + n - 1][1]))
            i += n
        sample.append((r.text, r.before, places, pairs(r.gold)))
        if typed:
            whole = [s for s in base_spans(r.text) if s in typed]
            for spoil in (False, True) * PLANTED if whole else ():
                sample += planted(r.text, r.before, whole, rng, spoil=spoil)
    return _train(sample)


def all_spans(text: str | None, field: SpanField) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with those that the field adds, both by kind and start."""
    if not text or not _HINT.search(text):
        return [], []
    base = base_spans(text)
    starts, ends = [], []  # of the base spans, overlapping ones as one
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    more = []
    for before, zone in zones(text):
        for k, a, b, p in field.decode(text, before, zone):
            last = bisect_right(starts, b - 1) - 1  # the last one that starts before b
            if p >= ACCEPT and (last < 0 or ends[last] <= a):
                more.append((k, a, b))
    return base, sorted(base + more)


def find(df: DataFrame, field: SpanField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, spans``: base spans and all spans of every whole text, in code points, end exclusive.

    Null and empty texts have none; repeated rows are each searched; an empty
    table gives an empty one.  Only the two named columns are used.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(in_slices(batches, "text", SLICE_BYTES), "id", "text"):
            found = [all_spans(x, field) for x in texts]
            columns = [[[{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in s[which]] for s in found] for which in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, span) for c in columns)], ["id", "base", "spans"])

    kind = "array<struct<kind: string, start: long, stop: long>>"
    return keyed_text(df, id_col, text_col).mapInArrow(lambda batches: lean(run(batches)), f"id long, base {kind}, spans {kind}").withColumnRenamed("id", id_col)


def report(df: DataFrame, field: SpanField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``: the contract's digest of :func:`find`, and the number of all spans."""
    found = find(df, field, id_col=id_col, text_col=text_col)

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(df: DataFrame, field: SpanField, *, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; overlapping spans are one, of the first kind.

    All rows and columns stay, null and empty texts as they are.
    """
    names = df.columns

    def clean(text: str | None) -> str | None:
        out, last = [], 0
        spans = sorted((a, b, k) for k, a, b in all_spans(text, field)[1])
        for n, (a, b, k) in enumerate(spans):
            if a >= last:
                out += [text[last:a], f"[{KINDS[k].upper()}]"]
            last = max(last, b)
        return "".join([*out, text[last:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col, SLICE_BYTES):
            i = names.index(text_col)
            cleaned = pa.array([clean(x) for x in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], cleaned, *batch.columns[i + 1 :]], names)

    return df.mapInArrow(lambda batches: lean(run(batches)), df.schema)


def digest(spans: list[Span]) -> str:
    """SHA-256 of the listed spans, in hexadecimal."""
    return hashlib.sha256(listed(spans).encode()).hexdigest()
