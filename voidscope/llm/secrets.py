"""Secrets in texts: fixed patterns, and character Markov models for what the patterns do not know.

Native: column expressions, joins and aggregates only. Two first-order character models are counted from a
bounded labelled sample: random strings (values that the patterns found) and ordinary runs (runs of the judged
characters of the same texts that no pattern touches, also short ones). A run of identifier characters whose
log-likelihood ratio is high enough is one more secret. Separators part a run: only neighboring letters and
digits are evidence, so paths, slugs and dates are judged by their words and numbers.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import bounded_sample
from voidscope.session import stage

# The base patterns, with the least length of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 12
ACCESS, ACCESS_LENGTH = r"AKIA[A-Z0-9]+", 18
HEX, HEX_LENGTH = r"[0-9a-f]+", 16
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}"  # candidates of the Markov models
_OTHER_RUN = "[A-Za-z0-9+/_=\ufffd-]{2,}"  # ordinary runs, if they do not hold the place of a pattern
SAMPLE_DOCS = 3000  # bound of the labelled sample, documents with and without base secrets each
THRESHOLD = 12.0  # log-likelihood ratio of a secret
SMOOTH = 0.5
MOST = 3.0  # evidence of one pair at most, so that no few unseen pairs make a secret
_MARK, _OTHER = "\ufdd0", "\ufffd"
_FIRST, _WIDTH = 32, 96  # printable ASCII


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans ``(start, kind, end, value)`` of the leftmost non-overlapping matches, in code points."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)  # odd parts are matches

    def step(acc, part):
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part.alias("value"))
        odd = acc["odd"]
        wanted = odd if keep is None else odd & keep(part)
        return F.struct(
            end.cast("long").alias("at"), (~odd).alias("odd"),
            F.when(wanted, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("odd"), _none().alias("found"))
    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(_none())


_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds by start, then kind. Runs of a class are maximal, so a least length may
    stand in the pattern for ``access`` and ``hex``; an ``assign`` match is judged after it is found."""
    def long_enough(part):
        return F.length(F.regexp_extract(part, ASSIGN, 1)) >= ASSIGN_LENGTH

    return F.sort_array(F.concat(
        _matches(text, ASSIGN, 0, long_enough),
        _matches(text, f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", 1),
        _matches(text, f"[0-9a-f]{{{HEX_LENGTH},}}", 2)))


def _clean(text: Column) -> Column:
    """Whole text, NULL as empty; the split mark (a noncharacter) becomes another character of length one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.contains(_MARK), F.translate(text, _MARK, _OTHER)).otherwise(text)


def _pairs(words: DataFrame, label: str) -> DataFrame:
    """Counts of neighboring characters of ``word``: ``a, b, label, n``."""
    word = F.col("word")
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(word) - 1),
        lambda i: F.struct(F.ascii(F.substring(word, i, F.lit(1))).alias("a"), F.ascii(F.substring(word, i + 1, F.lit(1))).alias("b")))
    return words.filter(F.length(word) > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(
        F.count("*").alias("n")).select("a", "b", F.lit(label).alias("label"), "n")


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios of character pairs (random over ordinary), ``_WIDTH`` x ``_WIDTH``.

    The labelled sample is bounded by ``sample_docs`` documents with a base secret and as many without.
    Smoothing spreads an unseen random pair evenly; without any sample the ratios are zero.
    """
    text = _clean(F.col("text"))
    hit = text.rlike(ASSIGN) | text.rlike(f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}") | text.rlike(f"[0-9a-f]{{{HEX_LENGTH},}}")
    flagged = stage(docs.filter("doc_id is not null").select("doc_id", hit.alias("hit")), "secret-flags")
    chosen = bounded_sample(flagged, "hit", "doc_id", sample_docs).select("doc_id").distinct()
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the parameter
    rows = stage(rows.withColumn("spans", base_spans(F.col("text"))), "secret-sample")
    values = F.transform("spans", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 1)).otherwise(s["value"]))
    random = rows.select(F.explode(values).alias("word")).distinct()
    plain = F.translate("text", _OTHER, " ")
    masked = F.regexp_replace(F.regexp_replace(plain, ASSIGN, _OTHER), f"{ACCESS}|[0-9a-f]{{{HEX_LENGTH},}}", _OTHER)
    runs = F.regexp_extract_all(masked, F.lit(_OTHER_RUN), 0)
    ordinary = rows.select(F.explode(runs).alias("word")).filter(~F.col("word").contains(_OTHER)).distinct()
    found = _pairs(random, "random").union(_pairs(ordinary, "ordinary")).collect()  # at most 2 x 95 x 95 rows
    return ratios([tuple(r) for r in found])


def _alphanumeric(code: int) -> bool:
    return code < 128 and chr(code).isalnum()


def ratios(counts: list[tuple[int, int, str, int]]) -> list[float]:
    """Smoothed conditional log probabilities of the second character, random minus ordinary.

    Only letters and digits are counted. Pairs with a separator, and pairs after a character that the ordinary
    runs do not hold, are no evidence; no pair gives more than ``MOST``.
    """
    counts = [r for r in counts if _alphanumeric(r[0]) and _alphanumeric(r[1])]
    table = {(a, b, label): n for a, b, label, n in counts}
    sums: dict[tuple[int, str], int] = {}
    for a, _, label, n in counts:
        sums[a, label] = sums.get((a, label), 0) + n
    if len({label for _, _, label, _ in counts}) < 2:
        return [0.0] * (_WIDTH * _WIDTH)
    alphabet = 62  # letters and digits
    out = []
    for a in range(_FIRST, _FIRST + _WIDTH):
        for b in range(_FIRST, _FIRST + _WIDTH):
            if not (_alphanumeric(a) and _alphanumeric(b) and (a, "ordinary") in sums):
                out.append(0.0)
                continue
            # few random samples: pull their model to an even one
            p, q = (
                (table.get((a, b, label), 0) + smooth) / (sums.get((a, label), 0) + smooth * alphabet)
                for label, smooth in (("random", 4 * SMOOTH), ("ordinary", SMOOTH)))
            out.append(min(MOST, round(log(p / q), 4)))
    return out


def _ratio(run: Column, model: list[float]) -> Column:
    table = F.lit(model)

    def code(i):
        return F.ascii(F.substring(run, i, F.lit(1))) - _FIRST

    return F.aggregate(
        F.sequence(F.lit(1), F.length(run) - 1), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.get(table, code(i) * _WIDTH + code(i + 1)), F.lit(0.0)))


def spans_of(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Struct ``(base, added)`` of span arrays ``(start, kind, end, value)`` for one text.

    ``base`` holds the pattern matches by start and kind; ``added`` the runs that the Markov models call random
    and that touch no base span.
    """
    text = _clean(text)
    runs = _matches(text, RUN, 3, lambda part: _ratio(part, model) >= threshold)

    def both(base):
        free = F.filter(runs, lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
        return F.struct(base.alias("base"), free.alias("added"))

    return F.get(F.transform(F.array(base_spans(text)), both), F.lit(0))  # the base spans are computed once


def find_secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, base, added`` of every row of ``docs(doc_id, text)``, as in :func:`spans_of`.

    NULL and empty texts have no spans. Repeated rows give repeated results; further columns of the input are
    not read.
    """
    return docs.select("doc_id", spans_of(F.col("text"), model, threshold).alias("s")).select("doc_id", "s.*")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts per base kind, SHA-256 of the joined base spans, all spans joined."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0).cast("long")).cast("int"))


def redact(text: Column, base: Column, added: Column, marker: str = "[secret]") -> Column:
    """Text with every span, overlaps merged, replaced by ``marker``."""
    def step(acc, span):
        new = span["start"] >= acc["at"]
        piece = F.concat(_between(text, acc["at"], span["start"]), F.lit(marker))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"),
            F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        F.sort_array(F.concat(base, added)), start, step,
        lambda acc: F.concat(acc["out"], _between(text, acc["at"], F.length(text).cast("long"))))
    return F.when(F.size(base) + F.size(added) > 0, whole).otherwise(text)
