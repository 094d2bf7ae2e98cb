"""Outputs as text files, in the order of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import from_json, to_json


@dataclass(frozen=True)
class Style:
    """How values are written: indent None is compact; raw writes strings unquoted; join adds no line ends (and is raw)."""

    indent: int | str | None = None
    raw: bool = False
    join: bool = False
    nul: bool = False
    ascii_only: bool = False
    sort_keys: bool = False
    seq: bool = False

    @property
    def end(self) -> str:
        return "\0" if self.nul else "" if self.join else "\n"

    def text(self, value) -> str:
        if isinstance(value, str) and (self.raw or self.join or self.nul):
            if self.nul and "\0" in value:
                raise ValueError("Cannot dump a string containing NUL with --raw-output0 option")
            return value
        return ("\x1e" if self.seq else "") + to_json(value, self.indent, self.sort_keys, self.ascii_only)


def styled(outputs: DataFrame, style: Style) -> DataFrame:
    """outputs (…, value: JSON text) with value as it is written; values that need no change stay in the JVM."""
    if style in (Style(), Style(seq=True)):
        return outputs.withColumn("value", F.concat(F.lit("\x1e"), "value")) if style.seq else outputs
    if style in (Style(raw=True), Style(join=True), Style(raw=True, join=True)):
        text = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]
        return outputs.withColumn("value", F.when(F.startswith("value", F.lit('"')), text).otherwise(F.col("value")))

    @F.udf("string", useArrow=True)
    def show(text: str) -> str:
        return style.text(from_json(text))

    return outputs.withColumn("value", show("value"))


def write_text(outputs: DataFrame, path: str, style: Style = Style()) -> None:
    """Part files whose order, and the order in them, is that of documents."""
    order = [c for c in ("file", "place", "turn") if c in outputs.columns]
    shown = styled(outputs, style)
    shown = shown.orderBy(*order) if order else shown
    if style.end:
        shown.select("value").write.option("lineSep", style.end).text(path)
    else:
        shown.agg(F.array_join(F.collect_list("value"), "").alias("value")).coalesce(1).write.text(path)
