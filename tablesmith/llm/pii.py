"""Personal data, and the terms that give it away.

Identifiers (addresses, card and phone numbers) are found by pattern. In their lines an information-theoretic measure
decides which ordinary terms disclose a protected entity: with ``n`` lines in the corpus, a term ``t`` in the line of
an entity ``e`` discloses

    PMI(t; e) / IC(e) = log(n * n(t, e) / (n(t) * n(e))) / log(n / n(e))

of what there is to know about ``e``: 1 if the term occurs with the entity only, 0 if they are independent. Terms
above ``remove_at`` are removed, those above ``generalise_at`` are replaced by their general form, in all texts. A pair
counts only if chance does not explain it: with ``k`` of an entity's ``m`` different lines holding the term, the binomial
tail (Chernoff's bound) times the number of pairs must be at most ``significance``. Copies of one line are no evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitmap import SLOTS, as_flags, bitmap_of
from .common import pick, plain, small_batches, stored, table, text_slices, texts

KINDS = ("email", "ip", "card", "phone", "term")
#: Terms that a task counts before it sends them on.
COUNTED_TERMS = 200_000
#: A term's second bit is that of the upper bits of its checksum, so common words seldom pass by chance.
_HIGH = 10

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run: from a later one the same attempt fails or was consumed.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, position = text.find("@"), 0
    while at >= 0:
        local = text[position:at]
        start = position + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        position = found.end() if found else at + 1
        at = text.find("@", position)


def find_identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    spans = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _outside(text: str, spans: list[tuple[int, int]], begin: int, close: int) -> Iterator[re.Match]:
    """The terms of ``text`` from ``begin`` to ``close`` that are in none of the sorted ``spans``."""
    at = begin
    for start, end in [*spans, (close, close)]:
        if start > at:
            yield from _TERM.finditer(text, at, start)
        at = max(at, end)


def _mentions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, list[int], list[str]]]:
    """(line, entities, terms) for each line with an identifier."""
    lines: dict[int, list] = {}
    for kind, start, end in spans:
        lines.setdefault(text.rfind("\n", 0, start) + 1, []).append((start, end, kind))
    for begin, inside in lines.items():
        close = text.find("\n", begin)
        close = len(text) if close < 0 else close
        inside.sort()
        terms = {m[0].lower() for m in _outside(text, [(s, e) for s, e, _ in inside], begin, close)}
        yield _hash(text[begin:close]), sorted({_hash(f"{kind}:{text[start:end]}") for start, end, kind in inside}), sorted(terms)


_FOUND = "doc_id long, text_key long, n_lines long, spans array<struct<kind string, start long, end long>>, mentions array<struct<line long, entities array<long>, terms array<string>>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("line", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _MENTION]
    for batch in batches:
        for part in text_slices(batch, "text"):
            keys, lines, spans, mentions = [], [], [], []
            for text in texts(part, "text"):
                found = find_identifiers(text)
                keys.append(_hash(text))
                lines.append(text.count("\n") + 1)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                mentions.append([dict(zip(names, m)) for m in _mentions(text, found)])
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(keys, pa.int64()), pa.array(lines, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))],
                ["doc_id", "text_key", "n_lines", "spans", "mentions"],
            )


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def _line_counts(packed: bytes):
    """Lines with each candidate term, summed up in the task; it sends what it has when its table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flags = as_flags(packed)

        def sent() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for part in text_slices(batch, "text"):
                here: Counter = Counter()
                for text in texts(part, "text"):
                    for line in text.split("\n"):
                        here.update({w.lower() for w in _TERM.findall(line)})
                for term, n in here.items():
                    if flags[_slot(term)]:
                        counts[term] += n
                if len(counts) > COUNTED_TERMS:
                    yield sent()
        if counts:
            yield sent()

    return run


def _occurrences(low: bytes, high: bytes):
    """Every occurrence, in any text and outside identifiers, of the terms whose two bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs = as_flags(low), as_flags(high)
        wanted: dict[str, bool] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), texts(part, "text")):
                    if len(wanted) > COUNTED_TERMS:
                        wanted.clear()
                    new = {w for w in _TERM.findall(text)}
                    for w in [w for w in new if w not in wanted]:
                        crc = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
                        wanted[w] = bool(lows[crc & (SLOTS - 1)] and highs[crc >> _HIGH])
                    if not any(wanted[w] for w in new):
                        continue
                    key, spans = _hash(text), sorted((start, end) for _, start, end in find_identifiers(text))
                    rows += [(doc, key, m[0].lower(), m.start(), m.end()) for m in _outside(text, spans, 0, len(text)) if wanted.get(m[0])]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "text_key", "term", "start", "end"])

    return run


def disclosures(docs: DataFrame, remove_at: float = 0.9, generalise_at: float = 0.75, significance: float = 0.01) -> DataFrame:
    """(doc_id, spans, actions) for every row: identifiers, then all occurrences of terms that disclose one, by kind and start.

    ``spans`` are (kind, start, end) in code points; ``actions`` says for each "remove" or "generalise". A null text is
    empty. Repeated rows count as lines as often as they occur and each gets its result; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "doc_id", "text")
    found = stored(docs.mapInArrow(_find, _FOUND), "identifiers")
    mentions = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*").distinct()
    named = mentions.select("line", "terms", F.explode("entities").alias("entity"))
    counted = lambda rows, *by: rows.groupBy(*by, "line").agg(F.count("*").alias("n")).groupBy(*by)
    pairs = stored(counted(named.select("entity", "line", F.explode("terms").alias("term")), "entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("pair_lines")), "pairs")
    tests = pairs.count()
    crc = F.crc32(F.encode("term", "UTF-8"))
    if not tests:
        revealing = None
    else:
        packed = bitmap_of(pairs.select(crc.alias("slot")), "slot")
        total = max(1, found.agg(F.sum("n_lines")).first()[0] or 0)
        terms = docs.mapInArrow(_line_counts(packed), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
        entities = counted(named, "entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("entity_lines"))
        share, chance = F.col("pair_lines") / F.col("entity_lines"), F.least(F.col("n_term") / F.lit(float(total)), F.lit(1.0))
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - chance))).otherwise(0.0)
        scored = pairs.join(terms, "term").join(entities, "entity").withColumn(
            "disclosure", F.log(F.lit(float(total)) * F.col("n_pair") / (F.col("n_term") * F.col("n_entity"))) / F.log(F.greatest(F.lit(float(total)) / F.col("n_entity"), F.lit(1.0 + 1e-9)))
        ).filter((share > chance) & (F.lit(math.log(tests / significance)) <= F.col("entity_lines") * (share * F.log(share / chance) + rest)))
        revealing = stored(scored.filter(F.col("disclosure") >= generalise_at).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "revealing")
    base = found.select("doc_id", "text_key", "spans")
    if revealing is None:
        return base.selectExpr("doc_id", "spans", "transform(spans, s -> 'remove') as actions")
    low, high = bitmap_of(revealing.select(crc.alias("slot")), "slot"), bitmap_of(revealing.select(F.shiftrightunsigned(crc, _HIGH).alias("slot")), "slot")
    hits = docs.mapInArrow(_occurrences(low, high), "doc_id long, text_key long, term string, start long, end long").join(revealing, "term")
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    per_text = hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end", action.alias("action")))).alias("terms"))
    right = per_text.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "terms")
    joined = base.join(right, base.doc_id.eqNullSafe(right.d) & (base.text_key == right.k), "left")
    return joined.selectExpr(
        "doc_id",
        "if(terms is null, spans, concat(spans, transform(terms, t -> named_struct('kind', 'term', 'start', t.start, 'end', t.end)))) as spans",
        "concat(transform(spans, s -> 'remove'), coalesce(transform(terms, t -> t.action), array())) as actions",
    )


def general_form(term: str) -> str:
    """What is left of a generalised term: its length class and case."""
    size = "short" if len(term) <= 5 else "long"
    return f"[{size} {'name' if term[:1].isupper() else 'word'}]"


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with identifiers replaced by their kinds and disclosing terms removed or generalised.

    Every row is cleaned by itself, also those without a doc_id, with one that others share, or that repeat; a null text
    stays null. The rows are numbered once, in a stored copy.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    numbered = stored(docs.select(*[F.col(plain(n)) for n in names], F.monotonically_increasing_id().alias("sanitised_row")), "sanitise")
    found = disclosures(numbered.select(F.col("sanitised_row").alias("doc_id"), "text"), **thresholds).filter("size(spans) > 0").selectExpr("doc_id as sanitised_id", "spans as sanitised_spans", "actions as sanitised_actions")
    joined = numbered.join(found, F.col("sanitised_row") == F.col("sanitised_id"), "left")

    def clean(text: str | None, spans: list | None, actions: list | None) -> str | None:
        if text is None or not spans:
            return text
        out, at = [], 0
        for (kind, start, end), action in sorted(zip([(s["kind"], s["start"], s["end"]) for s in spans], actions), key=lambda x: x[0][1:]):
            if start >= at:
                word = text[start:end]
                out += [text[at:start], f"[{kind}]" if kind != "term" else "[...]" if action == "remove" else general_form(word)]
            at = max(at, end)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "sanitised_spans", "sanitised_actions")))
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array([clean(*r) for r in rows], pa.string()))
                yield part.select(names)

    return joined.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosures(table(spark, sf_dir, "documents"))
    text = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind <> 'term')"
    count = {k: f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in KINDS}
    term = count.pop("term")
    return found.selectExpr("doc_id", *count.values(), f"sha2({text.format(base)}, 256) as base_sha256", f"{text.format('spans')} as spans", term)


QUERIES = {"op5_pii": (op5_pii, None)}
