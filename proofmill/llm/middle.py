"""Fill-in-middle: documents cut into prefix, middle and suffix, and put together in another order.

A batch of texts goes through Arrow's compute functions as a whole: lines become a list
array, the list is flattened with the parent of each line, a line's ordinal in its
document tells its role, lines of one role are filtered and put back into lists, and
each list is joined. Only the cut points come from Spark: they are a hash of the
document's id.

Defined results: a null text counts as empty; an empty text is ``plain``. A null doc_id
is hashed as an empty string. Repeated rows give equal results. Lines are cut at ``\\n``
alone and keep it. Other columns pass by. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from proofmill.llm import memo
from proofmill.llm.shared import table
from proofmill.llm.vec import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred documents, how many are cut, and how many of those put the suffix first.
RATE, SPM = 100, 50
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit integers that the key and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with their ends, the parent and the ordinal of each, and the number of lines of each text."""
    pieces = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parents = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    ordinals = np.arange(len(flat)) - first[parents]
    last = ordinals == counts[parents] - 1
    # what follows the last line end is a line only if it isn't empty
    real = ~last | pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.where(last, "", "\n"), pa.large_string())
    lines = pc.binary_join_element_wise(flat, ends, pa.scalar("", pa.large_string()))
    return lines.filter(pa.array(real)), parents[real], ordinals[real], np.bincount(parents[real], minlength=len(counts))


def joined(lines: pa.Array, parents: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """For each of n texts, its chosen lines as one string."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[chosen], minlength=n))])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), lines.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def transform(texts: pa.Array, drawn: list[np.ndarray], rate: int = RATE, spm: int = SPM) -> list[pa.Array]:
    """The columns of ``OUT`` of a batch of texts, given the four draws of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lines, parents, ordinals, n = units(texts)
    cuts = np.sort(np.stack([drawn[0] % (n + 1), drawn[1] % (n + 1)]), axis=0)
    low, high = cuts[0][parents], cuts[1][parents]
    prefix, middle, suffix = (joined(lines, parents, chosen, len(n)) for chosen in (ordinals < low, (ordinals >= low) & (ordinals < high), ordinals >= high))
    marked = np.zeros(len(n), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | marked | (drawn[2] % 100 >= rate))
    suffix_first = pa.array(drawn[3] % 100 < spm)
    text = lambda s: pa.scalar(s, pa.large_string())
    put = lambda *parts: pc.binary_join_element_wise(*parts, text(""))
    psm, spm_ = put(text(PREFIX), prefix, text(SUFFIX), suffix, text(MIDDLE), middle), put(text(SUFFIX), suffix, text(PREFIX), prefix, text(MIDDLE), middle)
    output = pc.if_else(plain, texts, pc.if_else(suffix_first, spm_, psm))
    form = pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm"))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output]


def _transformed(rate: int, spm: int, schema: pa.Schema):
    @memo.task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                drawn = [part.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
                made = transform(part.column("text"), drawn, rate, spm)
                columns = [part.column("doc_id"), part.column("rest"), *made]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """Documents with ``fim``, a struct of ``OUT``, in place of their text; other columns stay, whatever their names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias("r"), *(F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(others)))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"), *(h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))))
    schema = T.StructType([narrow.schema["doc_id"], narrow.schema["rest"], *T.StructType.fromDDL(OUT)])
    made = narrow.mapInArrow(_transformed(rate, spm, to_arrow_schema(schema)), schema)
    return made.select("doc_id", *(F.col("rest")[f"r{i}"].alias(c) for i, c in enumerate(others)), F.struct(*T.StructType.fromDDL(OUT).names).alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from: no cut text holds a mark, so the marks part it."""
    piece = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    # after the first mark: psm has prefix, suffix, middle; spm has suffix, prefix, middle
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(2), piece(4), piece(3))).otherwise(F.concat(piece(3), piece(4), piece(2)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's output and what is restored from it, as hashes."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
