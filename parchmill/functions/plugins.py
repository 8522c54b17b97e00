"""What users plug in: tokenizers as table functions, decisions and representations as callables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tokenizer = Callable[[str], Iterable[str]]


def register_tokenizer(spark: SparkSession, name: str, tokenize: Tokenizer) -> None:
    """Make ``tokenize`` a table function: SELECT t.* FROM lines, LATERAL name(text) t gives (pos, token)."""

    class Tokens:
        def eval(self, text: str):
            for i, t in enumerate(tokenize(text) if text is not None else ()):
                yield i, t

    spark.udtf.register(name, F.udtf(Tokens, returnType="pos INT, token STRING", useArrow=True))


#: Rows and bytes (those of one row at least) that a batch of tokens may come to.
BATCH_ROWS, BATCH_BYTES = 10_000, 4_000_000


def tokenized(df: DataFrame, text: str, tokenize: Tokenizer, pos: str = "pos", token: str = "token", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a row per token of ``text``, in Arrow batches; other columns, or those of ``keep``, repeat.

    A batch ends at ``BATCH_ROWS`` or about ``BATCH_BYTES``, also within a text, as a kept text repeats for each of its tokens.
    """
    kept = df.columns if keep is None else keep
    out = [df.schema[c] for c in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + f", `{pos}` INT, `{token}` STRING"

    def run(batches):
        import pyarrow as pa

        def batch(b, at, places, tokens):
            return pa.RecordBatch.from_arrays([*[b[c].take(pa.array(at, pa.int32())) for c in kept], pa.array(places, pa.int32()), pa.array(tokens, pa.string())], names=[*kept, pos, token])

        for b in batches:
            at, places, tokens, held = [], [], [], 0
            for i in range(len(b)):
                t = b[text][i].as_py()
                row = sum(b[c].slice(i, 1).nbytes for c in kept)
                for k, x in enumerate(tokenize(t) if t is not None else ()):
                    if at and (len(at) >= BATCH_ROWS or held + row + len(x) > BATCH_BYTES):
                        yield batch(b, at, places, tokens)
                        at, places, tokens, held = [], [], [], 0
                    at.append(i), places.append(k), tokens.append(x)
                    held += row + len(x)
            if at:
                yield batch(b, at, places, tokens)

    return df.mapInArrow(run, schema)


def decided(df: DataFrame, verify: Callable[..., bool], *columns: str) -> DataFrame:
    """The rows that a caller's predicate over some columns lets through; it is asked once for each distinct combination."""
    import pyarrow as pa

    distinct = df.select(*columns).distinct()

    def ask(batches):
        for b in batches:
            yield b.filter(pa.array([bool(verify(*r)) for r in zip(*[b[c].to_pylist() for c in columns])], pa.bool_()))

    asked = distinct.mapInArrow(ask, distinct.schema)
    on = None
    for c in columns:
        same = F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))
        on = same if on is None else on & same
    return df.alias("_l").join(asked.alias("_r"), on, "left_semi")
