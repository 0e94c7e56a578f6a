"""Quality rules with a ledger: every rule is evaluated once, its failure is a bit, policies are masks.

`measure` scans whole texts once and gives measurements; `ledger` turns them into one bit per rule; `apply_policy` and `ablation` work
on the bits alone, so another policy, or a rule left out, needs no second scan.

Nulls: a null text has no words (and fails "few_words"). Null ids and repeated rows are rows of their own. No rows: an empty ledger.
Other columns pass through `keep` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockdb.llm import common, text

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rule: (name, SQL condition under which a document fails). The number of a rule is its bit; new rules go at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words and 100 * n_symbols > 2 * word_chars"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("upper_case", "n_letters >= 40 and 100 * n_upper > 60 * n_letters"),
    ("digits", "word_chars > 0 and 100 * n_digits > 50 * word_chars"),
)
#: Versions of the policy: which rules reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "upper_case", "digits"),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def measure_texts(texts: list[str | None]) -> np.ndarray:
    """One row of MEASURES for each text."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    for a, b in text.blocks(texts):
        w = text.scan(texts[a:b])
        n = b - a
        sums = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[w.bounds])
        separator = text.SEPARATOR[w.data]
        letters = ((w.data | 32) >= 97) & ((w.data | 32) <= 122)
        out[a:b, 0] = w.counts
        out[a:b, 1] = sums(~separator & ((w.data & 0xC0) != 0x80))
        out[a:b, 2] = sums(SYMBOLS[w.data])
        out[a:b, 6] = sums((w.data >= 65) & (w.data <= 90))
        out[a:b, 7] = sums(letters)
        out[a:b, 8] = sums((w.data >= 48) & (w.data <= 57))
        # Lines: parted by \n and by the ends of texts; only those with a word count.
        cut = w.data == 10
        cut[w.bounds[1:] - 1] = True
        end = np.flatnonzero(cut)
        start = np.concatenate(([0], end[:-1] + 1))
        has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[has], end[has]
        line_doc = np.searchsorted(w.bounds, start, "right") - 1
        key = text.mix(w.span_hash(start, end) + line_doc.astype(text.U) * text.U(text.BASE))
        once = np.unique(key, return_index=True)[1]
        out[a:b, 5] = np.bincount(line_doc, minlength=n)
        out[a:b, 3] = out[a:b, 5] - np.bincount(line_doc[once], minlength=n)
        at, h = text.windows(w, WINDOW)
        if len(at):
            twice = text.repeated(text.mix(h + w.doc[at].astype(text.U) * text.U(text.BASE)))
            out[a:b, 4] = np.bincount(w.doc[text.covered(len(w.hash), at[twice], WINDOW)], minlength=n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are the column `text`, or that field of the column `row`."""
    for batch in batches:
        texts = batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text").cast(pa.string())
        found = measure_texts(texts.to_pylist())
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, j]) for j in range(len(MEASURES)))], [*names, *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    rows = common.text_rows(docs)
    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{m} long" for m in MEASURES)])
    return rows.mapInArrow(_measured, schema)


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, fail_bits."""
    return measure(docs).withColumn("fail_bits", fail_bits())


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    base = F.lit(mask(POLICIES["base"])).cast("long")
    return rows.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(base) != 0}).withColumn("kept", ~F.col("base_failed") & passes(policy))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail it alone, and would be kept without it. One row per rule."""
    used = mask(POLICIES[policy])
    hit = F.col("fail_bits").bitwiseAND(F.lit(used).cast("long"))
    patterns = rows.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if used >> i & 1))
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(fails).alias("failed"),
        total(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("kept_without"),
    )


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of `docs` that a policy keeps, with their columns; one scan, no join."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    marked = docs.select(row.alias("row"))
    schema = ", ".join([f"row {marked.schema['row'].dataType.simpleString()}", *(f"{m} long" for m in MEASURES)])
    out = marked.mapInArrow(_measured, schema).withColumn("fail_bits", fail_bits())
    return apply_policy(out, policy).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(common.table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
