"""Source files to analyzable chunks, and oversized chunks to line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnspark.functions.text import let, prefix_sums, split_lines_keep, tokens
from vulnspark.operators.source import ALL, FUNCTIONS, MODULE, chunk_rows, parse, parse_files

__all__ = ["ALL", "FUNCTIONS", "MODULE"]

CHUNK_SPAN = ("code", "start_line", "end_line", "start_byte", "end_byte")
CHUNK_ROW = (
    "name string, code string, start_line int, end_line int, start_byte bigint, end_byte bigint, "
    "head string, tail string"
)


def chunks_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per chunk of the files that `parse_files` parsed; `keys` are carried along."""
    module = F.create_map(F.lit("scope"), F.lit("module"))
    rows = parsed.select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.*")
    return rows.withColumns(
        {
            "window_index": F.lit(0),
            "window_count": F.lit(1),
            "metadata": F.when(F.col("is_module"), module).otherwise(F.create_map().cast("map<string,string>")),
        }
    ).drop("is_module")


def chunk_files(files: DataFrame, keys: list[str], scope: str = ALL) -> DataFrame:
    """One row per chunk of each file's `content`; `keys` are carried along.

    Outermost functions (methods included), runs of other top-level statements, or both. Files
    without a chunk because they do not parse are listed by `source.unparsable_files`.
    """
    return chunks_of(parse_files(files, keys, scope), keys)


class ChunkSource:
    """Python UDTF body: LATERAL chunk_source(content, scope) in SQL."""

    def eval(self, content: str, scope: str):
        tree, _ = parse(content)
        for row in chunk_rows(tree, content, scope) if tree else ():
            yield row[:-1]


def register_chunk_udtf(spark, name: str = "chunk_source") -> None:
    spark.udtf.register(name, F.udtf(ChunkSource, returnType=CHUNK_ROW))


def window_array(
    code: Column,
    start_line: Column,
    end_line: Column,
    start_byte: Column,
    end_byte: Column,
    max_tokens: int = 512,
    stride_tokens: int = 128,
    token_count: Column | None = None,
) -> Column:
    """Windows of one chunk as array<struct<code, start_line, end_line, start_byte, end_byte>>.

    A chunk within `max_tokens` is its own only window. A larger one is cut on lines, the
    window size coming from its average tokens per line; the first window that reaches the
    last line is the last one.
    """
    n_tokens = F.size(tokens(code)) if token_count is None else token_count

    def sizes(text: Column) -> Column:
        n_lines = F.size(text["lines"])
        per_line = F.greatest(text["n"] / F.greatest(n_lines, F.lit(1)), F.lit(1e-6))
        size = F.greatest(F.floor((max_tokens - 8) / per_line), F.lit(1)).cast("int")
        back = F.greatest(F.floor(stride_tokens / per_line), F.lit(1)).cast("int")
        return F.struct(
            text["lines"].alias("lines"),
            size.alias("size"),
            F.greatest(size - F.least(back, size - 1), F.lit(1)).alias("step"),
            prefix_sums(F.transform(text["lines"], F.octet_length)).alias("ends"),
        )

    def cut(plan: Column) -> Column:
        n_lines = F.size(plan["lines"])
        count = F.greatest(F.ceil((n_lines - plan["size"]) / plan["step"]), F.lit(0)) + 1

        def window(i: Column) -> Column:
            first = i * plan["step"]
            last = F.least(first + plan["size"], n_lines)
            return F.struct(
                F.array_join(F.slice(plan["lines"], first + 1, last - first), "").alias("code"),
                (start_line + first).alias("start_line"),
                (start_line + last - 1).alias("end_line"),
                (start_byte + F.coalesce(F.get(plan["ends"], first - 1), F.lit(0))).alias("start_byte"),
                (start_byte + F.get(plan["ends"], last - 1)).alias("end_byte"),
            )

        return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), window)

    whole = F.array(
        F.struct(
            code.alias("code"),
            start_line.alias("start_line"),
            end_line.alias("end_line"),
            start_byte.alias("start_byte"),
            end_byte.alias("end_byte"),
        )
    )
    text = F.struct(n_tokens.alias("n"), split_lines_keep(code).alias("lines"))
    return let(
        text, lambda t: F.when(t["n"] <= max_tokens, whole).otherwise(let(sizes(t), cut))
    )


def with_windows(chunks: DataFrame, **options) -> DataFrame:
    """Adds `windows`, the array of `window_array`; row-local, nothing is shuffled."""
    span = [F.col(c) for c in CHUNK_SPAN]
    return chunks.withColumn("windows", window_array(*span, **options))


def line_windows(chunks: DataFrame, **options) -> DataFrame:
    """Chunks with each oversized one replaced by its line windows."""
    cut = with_windows(chunks, **options).withColumn("window_count", F.size("windows"))
    kept = [c for c in cut.columns if c not in (*CHUNK_SPAN, "windows", "window_index")]
    # The outer form, because the plain one adds a filter on the array's size, which is pushed
    # down and computes the windows a second time. No array of windows is empty.
    return cut.select(*kept, F.posexplode_outer("windows").alias("window_index", "w")).select(
        *kept, "window_index", "w.*"
    )
