"""What the tests of this folder share."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 50_000
# Names that the operators use inside themselves.
CLASHES = ["slice", "seq", "row", "block", "salt", "rank", "node", "component", "key", "score", "digest", "spans", "n_removed", "host", "dim", "_digest", "_spans", "_doc", "_found", "digest_of", "given", "of", "text_digest", "kept"]


def extra(df):
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHES])


def rows_of(df, *columns):
    """Rows in a fixed order, nulls first."""
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))
