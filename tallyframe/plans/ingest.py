"""Exports to normalised facts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..config import DEFAULT, MetricConfig
from ..operators import sheets as sh
from ..sources.scratch import settle


@dataclass(frozen=True)
class Ingested:
    """Everything read from one set of exports; all frames are lazy but ``sheets``."""

    parsed: DataFrame
    sheets: DataFrame
    specs: DataFrame
    granularity: str
    config: MetricConfig

    def settled(self) -> Ingested:
        """The same with its rows written out, for use by several tables."""
        return replace(self, parsed=settle(self.parsed, "parsed-rows"))

    @property
    def facts(self) -> DataFrame:
        return sh.normalized(self.parsed, self.config)

    @property
    def mapping(self) -> DataFrame:
        return sh.column_mapping(self.sheets, self.config)

    @property
    def quarantine(self) -> DataFrame:
        return sh.quarantine(self.parsed, self.sheets, self.specs, self.granularity, self.config)

    def metrics(self) -> list[str]:
        """Metrics some usable sheet has; without any usable sheet, an error."""
        found = sh.mapped_metrics(self.sheets, self.config)
        if not found:
            raise ValueError("no readable sheet: none has a date column and a known metric")
        return found


def ingest(
    grid: DataFrame, specs: DataFrame, granularity: str = "day", config: MetricConfig = DEFAULT,
    header_rows: int = sh.HEADER_SEARCH_ROWS,
) -> Ingested:
    """``header_rows`` is how many rows of a sheet are looked at for its header."""
    table = sh.sheet_table(grid, specs, config, header_rows)
    parsed = sh.parsed_rows(grid, table, granularity, config)
    return Ingested(parsed, table, specs, granularity, config)
