"""The engine over DataFrames: detect, redact, list and count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillmask.functions.entities import SPAN_DDL, SPAN_FIELDS, Settings
from quillmask.functions.entities import settings as make_settings
from quillmask.functions.local import Later, LocalEngine, Span
from quillmask.functions.netguard import offline
from quillmask.functions.patterns import HAS_DIGIT
from quillmask.functions.wordlist import FEW, SharedWords
from quillmask.operators.arrow_tiers import detectors, python_spans
from quillmask.operators.clusters import free_prefix
from quillmask.operators.policy import applied
from quillmask.operators.scoring import adjusted, confident, exploded, resolved
from quillmask.operators.tiers import ORD_WORDS, native_tiers, none
from quillmask.session import ship_package
from quillmask.sources import files


class Masker:
    """Finds and rewrites sensitive text in a column.

    Each tier is a projection of its own, so no match is computed twice; Python runs only where the
    settings name a detector that needs it. A null text gives null and no detections.
    """

    def __init__(self, settings: Settings | None = None, **options):
        self.settings = settings or make_settings(**options)

    # -- DataFrames -------------------------------------------------------

    def _candidates(self, frame: DataFrame, text: str, out: str) -> tuple[DataFrame, str]:
        """The frame with candidates and a copy of the text, and the copy's name: ``text`` can be a field of
        a struct, or a name that an output takes."""
        lead = free_prefix([*frame.columns, out])
        copy, digits, by_python = f"{lead}text", f"{lead}digits", f"{lead}python"
        tiers = {lead + name: tier for name, tier in native_tiers(copy, self.settings, F.col(digits)).items()}
        python = detectors(self.settings)
        if len(self.settings.custom_words) > FEW:
            python.append((ORD_WORDS, SharedWords(frame.sparkSession.sparkContext, self.settings.custom_words)))
        wide = frame.withColumn(copy, F.col(text)).withColumn(digits, F.col(copy).rlike(HAS_DIGIT)).select("*", *[c.alias(n) for n, c in tiers.items()])
        if python:
            ship_package(frame.sparkSession)
            wide = wide.withColumn(by_python, python_spans(F.col(copy), python, self.settings.offline))
        names = [*tiers, *[by_python] * bool(python)]
        joined = F.concat(*map(F.col, names)) if names else none()
        return wide.withColumn(out, joined).drop(digits, *names), copy

    def _scored(self, frame: DataFrame, text: str, out: str) -> tuple[DataFrame, str]:
        found, copy = self._candidates(frame, text, out)
        some = F.when(F.size(out) > 0, adjusted(F.col(copy), F.col(out))).otherwise(F.col(out))
        return found.withColumn(out, some).withColumn(out, confident(F.col(out), self.settings.min_confidence)), copy

    def _kept(self, frame: DataFrame, text: str, out: str) -> tuple[DataFrame, str]:
        scored, copy = self._scored(frame, text, out)
        return scored.withColumn(out, resolved(out)), copy

    def candidates(self, frame: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
        """Adds every tier's candidates, before scoring."""
        found, copy = self._candidates(frame, text, out)
        return found.drop(copy)

    def scored(self, frame: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
        """Candidates with context applied and the unsure left out."""
        found, copy = self._scored(frame, text, out)
        return found.drop(copy)

    def detect(self, frame: DataFrame, text: str = "text", out: str = "detections") -> DataFrame:
        """Adds ``out``, array of detections by start."""
        found, copy = self._kept(frame, text, out)
        return found.withColumn(out, public(F.col(out))).drop(copy)

    def redact(self, frame: DataFrame, text: str = "text", out: str = "redacted", detections: str = "detections") -> DataFrame:
        """Adds the detections and the rewritten text."""
        found, copy = self._kept(frame, text, detections)
        whole = found.withColumn(out, applied(F.col(copy), F.col(detections), self.settings.policy))
        return whole.withColumn(detections, public(F.col(detections))).drop(copy)

    def spans(self, frame: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """One row a detection: keys, ord (place in the document) and the detection's fields; a field
        that has a key's name is called span_ and its name."""
        lead = free_prefix(keys + [text])
        found = self.detect(frame.select(*dict.fromkeys([*keys, text])), text, f"{lead}d")
        rows = exploded(found, keys, f"{lead}d", f"{lead}s", f"{lead}ord")
        fields = [F.col(f"{lead}ord").alias("span_ord" if "ord" in keys else "ord"), *[F.col(f"{lead}s.{f}").alias(f"span_{f}" if f in keys else f) for f in SPAN_FIELDS]]
        return rows.select(*keys, *fields)

    def summary(self, frame: DataFrame, by: list[str] | None = None, text: str = "text") -> DataFrame:
        """How many detections of each type, by the given columns."""
        lead = free_prefix([*(by or []), text])
        found = self.detect(frame.select(*dict.fromkeys([*(by or []), text])), text, f"{lead}d")
        rows = exploded(found, by or [], f"{lead}d", f"{lead}s").select(*(by or []), F.col(f"{lead}s.entity_type").alias("entity_type"))
        return rows.groupBy(*(by or []), "entity_type").agg(F.count("*").alias("n"))

    # -- strings ----------------------------------------------------------

    def local(self) -> LocalEngine:
        return LocalEngine(self.settings)

    def detect_text(self, text: str) -> list:
        return self.local().detect(text)

    def redact_text(self, text: str) -> str:
        return self.local().redact(text)

    # -- chunks and files, in bounded memory ------------------------------

    def detect_stream(self, chunks: Iterable[str]) -> Iterator[tuple[str, list[Span]]]:
        return files.detect_stream(chunks, self.settings)

    def span_stream(self, chunks: Iterable[str]) -> Iterator[Span]:
        return files.span_stream(chunks, self.settings)

    def redact_stream(self, chunks: Iterable[str]) -> Iterator[str]:
        return files.redact_stream(chunks, self.settings)

    def redact_file(self, source: str, target: str, **how) -> int:
        return files.redact_file(source, target, self.settings, **how)


def public(spans: Column) -> Column:
    """Detections as callers see them: the plan's helper fields become ``meta``."""

    def one(s: Column) -> Column:
        entries = F.array(F.struct(F.lit("context").alias("key"), s["context"].alias("value")), F.struct(F.lit("entropy").alias("key"), s["entropy"].alias("value")))
        meta = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        return F.struct(s["start"], s["end"], s["text"], s["entity_type"], s["confidence"], s["source"], meta.alias("meta"))

    return F.transform(spans, one).cast(f"array<{SPAN_DDL}>")


def register_sql(spark: SparkSession, masker: Masker) -> None:
    """SQL functions ``quill_redact(text)`` and ``quill_count(text)``, in Arrow batches, and the table
    function ``quill_detect(text)`` for LATERAL joins, a row a detection: start, end, text, entity_type,
    confidence, source, meta. Its detectors cannot connect to other machines if the settings say so."""
    ship_package(spark)
    engine_of, guard = Later(masker.settings), masker.settings.offline
    shape = StructType.fromDDL(f"span {SPAN_DDL}")["span"].dataType

    @F.pandas_udf("string")
    def quill_redact(texts: pd.Series) -> pd.Series:
        engine = engine_of()
        with offline(guard):
            return texts.map(lambda t: None if t is None else engine.redact(t))

    @F.pandas_udf("int")
    def quill_count(texts: pd.Series) -> pd.Series:
        engine = engine_of()
        with offline(guard):
            return texts.map(lambda t: 0 if t is None else len(engine.detect(t)))

    class Detect:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.dataType != StringType():
                raise ValueError(f"quill_detect takes a string, not {text.dataType.simpleString()}")
            return AnalyzeResult(shape)

        def __init__(self, _analyzed: AnalyzeResult | None = None):
            self.engine = engine_of()

        def eval(self, text: str):
            if text is not None:
                with offline(guard):
                    found = self.engine.detect(text)
                for s in found:
                    yield s.start, s.end, s.text, s.entity_type, float(s.confidence), s.source, s.meta

    spark.udf.register("quill_redact", quill_redact)
    spark.udf.register("quill_count", quill_count)
    spark.udtf.register("quill_detect", F.udtf(Detect, useArrow=True))
