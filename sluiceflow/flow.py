"""A fluent chain over the operators.

    Flow.input(spark, "blast", path, "score").top("score", 100).run(report, schema).result()

Every step is a DataFrame transformation, so the whole chain is one Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.operators import sorting, verbs


class Flow:
    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def input(cls, spark: SparkSession, record_format: str, path: str, *identifiers: str) -> Flow:
        """Records of a registered format, with the identifiers later steps sort or score by."""
        from sluiceflow.sources.formats import read

        return cls(read(spark, record_format, path, *identifiers))

    def split(self, order_by: Sequence[str], split_size: int = 100_000_000, size: str | Column | None = None, name: str = "chunk") -> Flow:
        """Number chunks of `split_size` bytes (or, without `size`, of that many rows)."""
        if size is None:
            return Flow(verbs.split_by_count(self.df, order_by, split_size, name))
        column = F.col(size) if isinstance(size, str) else size
        return Flow(verbs.split_by_size(self.df, order_by, column, split_size, name))

    def run(self, application: Callable, schema: str, params: Mapping | None = None) -> Flow:
        """Apply a user function to batches of rows."""
        return Flow(verbs.run(self.df, application, schema, params))

    def transform(self, step: Callable[[DataFrame], DataFrame]) -> Flow:
        return Flow(self.df.transform(step))

    def map(self, step: Callable[[DataFrame], DataFrame], keys: DataFrame, order_by: Sequence[str]) -> Flow:
        """Continue with every pair of an input row and a key; `step` gets the pairs.

        Which side is the input of the next step is a matter of the columns it reads.
        """
        return Flow(step(verbs.fan_out(self.df, keys, order_by)))

    def combine(self, *others: Flow | DataFrame, sort: Sequence[str] = ()) -> Flow:
        """All rows of this and the other flows, in order when `sort` is given."""
        frames = [o.df if isinstance(o, Flow) else o for o in others]
        merged = verbs.combine(self.df, *frames)
        return Flow(merged.orderBy(*sort) if sort else merged)

    def sort(self, identifier: str, *ties: str, num_bins: int | None = None) -> Flow:
        """Total order by an identifier; `num_bins` fixes the number of range partitions."""
        keys = [identifier, *ties]
        if num_bins is None:
            return Flow(sorting.sort_range(self.df, *keys))
        return Flow(self.df.repartitionByRange(num_bins, *keys).sortWithinPartitions(*keys))

    def partition(self, identifier: str, num_bins: int) -> Flow:
        """Only the boundaries of the range partitions."""
        return Flow(sorting.pivots(self.df, identifier, num_bins))

    def top(self, identifier: str, number: int, *ties: str) -> Flow:
        return Flow(verbs.top(self.df, number, identifier, *ties))

    def match(self, key: str, score: str) -> Flow:
        return Flow(verbs.match(self.df, key, score))

    def write(self, record_format: str, path: str, *order_by: str) -> Flow:
        """Write the records in a registered format and go on with them."""
        from sluiceflow.sources.formats import writer

        writer(record_format)(self.df, path, order_by)
        return self

    def result(self) -> DataFrame:
        return self.df
