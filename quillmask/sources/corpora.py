"""Labelled corpora for measuring detectors: sentences built from a row's number and a hash.

``clean``: filler prose and one cued entity a sentence. ``hard``: records of logs, tables and code
with entities beside look-alikes that are none. Rows are (doc_id, text, gold); gold spans count
characters of the text. Everything follows from ``seed``, and any number of rows is made in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillmask.functions.validators import luhn_text
from quillmask.session import ship_package

GOLD = "doc_id long, text string, gold array<struct<start:int,end:int,type:string,text:string>>"
_FILLER = ("the report was filed", "nobody noticed the delay", "work went on as planned", "rain fell through the night", "a second copy was kept")
_CUE = {"email": "write by email to", "phone": "phone the office at", "credit_card": "charged to card", "ssn": "his ssn is", "ipv4": "from host"}


def _card(rng: np.random.Generator, valid: bool) -> str:
    while True:
        digits = "4" + "".join(map(str, rng.integers(0, 10, 15)))
        if luhn_text(digits) == valid:
            return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def entity(rng: np.random.Generator, kind: str) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    if kind == "email":
        return f"user{n(1, 9999)}@mail{n(1, 99)}.org"
    if kind == "phone":
        return f"+1 ({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"
    if kind == "credit_card":
        return _card(rng, True)
    if kind == "ssn":
        return f"{n(100, 665)}-{n(10, 99)}-{n(1000, 9999)}"
    return ".".join(str(n(1, 255)) for _ in range(4))


def lookalike(rng: np.random.Generator) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    hexes = lambda k: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, k))
    kinds = (
        lambda: _card(rng, False), lambda: ".".join(str(n(1, 255)) for _ in range(5)), lambda: str(n(100_000_000, 999_999_999)),
        lambda: f"{n(900, 999)}-{n(10, 99)}-{n(1000, 9999)}", lambda: "-".join(map(hexes, (8, 4, 4, 4, 12))), lambda: hexes(40),
        lambda: f"20{n(10, 30)}-{n(10, 12)}-{n(10, 28)}", lambda: f"TRK{n(10**8, 10**9)}",
    )
    return kinds[n(0, len(kinds))]()


def document(doc_id: int, seed: int, hard: bool, sentences: int) -> tuple[str, list[dict]]:
    rng = np.random.default_rng([seed, doc_id])
    text, gold = "", []
    for _ in range(sentences):
        kind = list(_CUE)[int(rng.integers(0, len(_CUE)))]
        value = entity(rng, kind)
        filler = _FILLER[int(rng.integers(0, len(_FILLER)))]
        frames = (f"{filler}, {_CUE[kind]} ",)
        if hard:
            apart = f"level=info module=worker.queue.dispatch note='{filler}'"
            frames = (f"{apart} ref={lookalike(rng)} {_CUE[kind]} ", f"{apart},{lookalike(rng)},{filler},{_CUE[kind]},", f'{{"note": "{apart}", "id": "{lookalike(rng)}", "{_CUE[kind]}": "')
        text += frames[int(rng.integers(0, len(frames)))]
        gold.append({"start": len(text), "end": len(text) + len(value), "type": kind, "text": value})
        text += value + ('"}\n' if text.endswith('"') else " .\n")
    return text, gold


def corpus(spark: SparkSession, documents: int, hard: bool = False, sentences: int = 20, seed: int | None = None) -> DataFrame:
    ship_package(spark)
    chosen = (7 if hard else 42) if seed is None else seed

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [document(i, chosen, hard, sentences) for i in frame["id"]]
            yield pd.DataFrame({"doc_id": frame["id"], "text": [t for t, _ in made], "gold": [g for _, g in made]})

    return spark.range(documents).mapInPandas(run, GOLD)
