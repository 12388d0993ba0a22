"""A cache of yes/no verdicts on pairs, and the filter it feeds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from string import Formatter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simweave.operators.incremental import delete_by_either
from simweave.operators.similarity import Form, similar_pairs
from simweave.operators.units import embedded
from simweave.scratch import materialize

PROMPT = "Two units of {type} were found alike ({similarity}).\n\nFirst, {left_name} in {left_path}:\n{left_code}\n\nSecond, {right_name} in {right_path}:\n{right_code}\n\nFiles:\n{left_file}\n---\n{right_file}\n\nShould they be merged into one? Answer yes or no."
#: The text before each field and the field's name, and the text behind the last.
_PIECES = [(before, name) for before, name, _, _ in Formatter().parse(PROMPT) if name]
_END = PROMPT.rpartition("}")[2]


def prompted(pairs: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``prompt``: both units (id, name, code) and the texts (file_path, text) of the files they are in; a missing file is empty."""
    code = lambda s: units.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("code").alias(f"{s}_code"))
    text = lambda s: texts.select(F.col("file_path").alias(f"{s}_file"), F.col("text").alias(f"{s}_text"))
    full = pairs.join(code("left"), "left_id").join(code("right"), "right_id").join(text("left"), "left_file", "left").join(text("right"), "right_file", "left")
    parts = {"type": "unit_type", "similarity": "similarity", "left_name": "left_name", "left_path": "left_file", "left_code": "left_code", "right_name": "right_name", "right_path": "right_file", "right_code": "right_code", "left_file": "left_text", "right_file": "right_text"}
    pieces = [x for before, name in _PIECES for x in (F.lit(before), F.coalesce(F.col(parts[name]).cast("string"), F.lit("")))]
    return full.withColumn("prompt", F.concat(*pieces, F.lit(_END))).select(*pairs.columns, "prompt")


def six_places(x: float) -> str:
    """Rounded half up in its shortest decimal form, as Spark does."""
    s = repr(x)
    return f"{x:.6f}" if len(s) > 12 else str(Decimal(s).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _prompting(digest: str | None) -> Callable[[Form], Form]:
    """Adds the prompt of a pair, or its digest, to the batches of pairs."""
    columns = {"name": "name", "path": "file_path", "code": "code", "file": "text"}

    def spelled(rows: pa.Table) -> list[tuple[str, list[bytes]]]:
        """Runs of pieces of one side, spelled out for every row."""
        out: list[tuple[str, list[bytes]]] = []
        for before, name in _PIECES[2:]:
            side, _, field = name.partition("_")
            lit = before.encode()
            texts = [lit + (v or "").encode() for v in rows.column(columns[field]).to_pylist()]
            if out and out[-1][0] == side:
                out[-1] = (side, [a + b for a, b in zip(out[-1][1], texts, strict=True)])
            else:
                out.append((side, texts))
        return out

    def wrap(form: Form) -> Form:
        last: list = [None, None]
        (first, _), (second, _) = _PIECES[:2]  # type and similarity

        def run(rows: pa.Table, left: np.ndarray, right: np.ndarray, kind: str, s: np.ndarray) -> pa.RecordBatch:
            if last[0] is not rows:
                last[:] = rows, spelled(rows)
            head, end = f"{first}{kind}{second}".encode(), _END.encode()
            at = {"left": left.tolist(), "right": right.tolist()}
            parts = [map(texts.__getitem__, at[side]) for side, texts in last[1]]
            whole = (b"".join((head, six_places(x).encode(), *p, end)) for x, *p in zip(s.tolist(), *parts, strict=True))
            prompt = [t.decode() for t in whole] if digest is None else [hashlib.new(digest, t, usedforsecurity=False).hexdigest() for t in whole]
            made = form(rows, left, right, kind, s)
            return pa.RecordBatch.from_arrays([*made.columns, pa.array(prompt, pa.string())], names=[*made.schema.names, "prompt"])

        return run

    return wrap


def similar_prompts(units: DataFrame, texts: DataFrame, threshold: float | dict[str, float], dirty: DataFrame | None = None, carry: tuple[str, ...] = (), digest: str | None = None) -> DataFrame:
    """The pairs of :func:`similar_pairs` with the ``prompt`` that :func:`prompted` gives them, or its ``digest`` (a name of hashlib) alone.

    Prompts are put together where the units of a pair meet, so no text is
    dealt out for each of its pairs; a tile holds about 32 MB of them.
    """
    known = units.where(embedded(F.col("embedding"))).select("id", "unit_type", "embedding", "name", "file_path", "code", *[c for c in carry if c not in ("name", "file_path", "code")])
    rows = known.join(texts.select("file_path", "text"), "file_path", "left")
    size = 1 + (F.coalesce(F.octet_length("code"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))) / 16384
    needed = tuple(dict.fromkeys(("name", "file_path", "code", "text", *carry)))
    return similar_pairs(rows, threshold, dirty, tile=2048, carry=needed, form=_prompting(digest), adds="prompt", keep=carry, size=size)


def parse_answer(raw: Column) -> Column:
    """yes for an answer that begins so, no for another; a missing answer (an error) is yes."""
    return F.when(raw.isNull() | F.startswith(F.lower(raw), F.lit("yes")), "yes").otherwise("no")


def with_cached(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ``verdict`` (null if unknown) by pair_key."""
    return pairs.join(verdicts.select("pair_key", "verdict"), "pair_key", "left")


def pending(pairs: DataFrame, verdicts: DataFrame, dirty: DataFrame) -> DataFrame:
    """Pairs (pair_key, left_file, right_file, ...) without a usable verdict: unknown, or a side is dirty."""
    fresh = delete_by_either(verdicts.select("pair_key", "verdict", "left_file", "right_file"), dirty, "left_file", "right_file")
    known = fresh.select("pair_key").distinct()
    clean = delete_by_either(pairs, dirty, "left_file", "right_file").join(known, "pair_key", "left_semi").select("pair_key").distinct()
    return pairs.join(clean, "pair_key", "left_anti").select(*pairs.columns)


def keep_true(pairs: DataFrame) -> DataFrame:
    """Only a no removes."""
    return pairs.where(F.coalesce("verdict", F.lit("yes")) != "no")


def classify(pairs: DataFrame, verdicts: DataFrame, dirty: DataFrame, ask: Callable[[Column], Column], prompt: Column) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``verdict``, new verdicts to store): cached verdicts for clean pairs, ``ask`` for the rest.

    ``ask`` maps a prompt column to an answer column (null: the call failed);
    failed calls keep the pair but are not stored. The answers are written
    down once: a call costs, and what is kept and what is stored must agree.
    """
    todo = pending(pairs, verdicts, dirty)
    asked = materialize(todo.withColumn("answer", ask(prompt)), "answers").withColumn("verdict", parse_answer(F.col("answer")))
    done = with_cached(pairs.join(todo.select("pair_key"), "pair_key", "left_anti"), verdicts)
    new = asked.where(F.col("answer").isNotNull()).select("pair_key", "verdict", "left_file", "right_file", F.unix_millis(F.current_timestamp()).alias("created_at"))
    return done.unionByName(asked.select(*done.columns)), new
