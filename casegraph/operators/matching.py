"""Rows of several tables brought together: look-ups, ownership, endpoints for sinks, tool items for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.operators.classify import eligible
from casegraph.operators.graph import collapse_edges, first_routes
from casegraph.scratch import materialize, release

SAME_FILE_CONFIDENCE = 0.85
#: Lines of one bucket of a symbol's range.
BUCKET_LINES = 64


def files_in_order(files: DataFrame) -> DataFrame:
    return files.orderBy("file_id")


def indexable(files: DataFrame) -> DataFrame:
    """Files that are indexed and searched: all but those of vendors."""
    return files.filter(~F.coalesce(F.col("is_vendor"), F.lit(False)))


def symbol_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """The symbol of that name with the least id; no row if there is none."""
    return symbols.filter(F.col("name") == name).orderBy("symbol_id").limit(1)


def symbols_by_name(symbols: DataFrame) -> DataFrame:
    """(name, symbol_id): ``symbol_by_name`` for every name at once."""
    return symbols.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"))


def of_scan(rows: DataFrame, scan_id: str) -> DataFrame:
    return rows.filter(F.col("scan_id") == scan_id)


def located(sinks: DataFrame, files: DataFrame) -> DataFrame:
    """``sinks`` with the path of their file."""
    return sinks.join(files.select("file_id", "rel_path"), "file_id")


def pending_paths(paths: DataFrame, sinks: DataFrame, files: DataFrame, scan_id: str) -> DataFrame:
    """Paths of a scan that are still to be resolved, with their sink and file."""
    own = of_scan(paths, scan_id).filter(F.col("state").isin(*S.PENDING_STATES)).select("path_id", "sink_id", "state")
    return located(own.join(sinks, "sink_id"), files)


def innermost_symbols(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``found`` (file_id, line_number, ...) with ``symbol_id``, the symbol around the line that starts last; null if there is none.

    Symbols are dealt to buckets of lines, so a row meets the symbols near its line only.
    """
    bucket = F.floor(F.col("line_number") / F.lit(BUCKET_LINES))
    spans = F.sequence(F.floor(F.col("start_line") / F.lit(BUCKET_LINES)), F.floor(F.greatest("start_line", "end_line") / F.lit(BUCKET_LINES)))
    dealt = symbols.select("file_id", F.col("symbol_id").alias("_own"), "start_line", "end_line", F.explode(spans).alias("_bucket"))
    places = found.select("file_id", "line_number", bucket.alias("_bucket")).distinct()
    inside = places.join(dealt, ["file_id", "_bucket"]).filter("line_number between start_line and end_line")
    owners = inside.groupBy("file_id", "line_number").agg(F.max_by("_own", F.struct("start_line", -F.col("_own"))).alias("symbol_id"))
    return found.join(owners, ["file_id", "line_number"], "left")


def placeholder_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files`` for names (rel_path) that were never discovered."""
    wanted = names.select("rel_path").filter("rel_path <> ''").distinct()
    missing = wanted.join(files.select("rel_path"), "rel_path", "left_anti")
    return missing.select("rel_path", F.lit("unknown").alias("language"), F.lit("unknown").alias("file_hash"), F.lit(1).cast("long").alias("loc"))


def gated_items(items: DataFrame, discovered: DataFrame, detector: Column) -> DataFrame:
    """``items`` (rel_path, ...) that their file's scope allows; an item of a file that was not discovered is allowed."""
    scopes = discovered.select("rel_path", "execution_domain", F.lit(True).alias("_there"))
    rows = items.join(scopes, "rel_path", "left")
    return rows.filter(F.col("_there").isNull() | eligible(F.col("execution_domain"), detector)).select(*items.columns)


def node_number(node: Column) -> Column:
    """The id in the name of a node."""
    return F.regexp_extract(node, r"_(-?\d+)$", 1).cast("long")


def first_endpoints(sinks: DataFrame, endpoints: DataFrame, edges: DataFrame, same_file: bool = True, max_hops: int = S.MAX_HOPS) -> DataFrame:
    """``sinks`` with the first endpoint, by id, from which they are reached: endpoint_id, nodes, hops, reach, edge_types.

    ``edges``: of the whole graph. One search from all endpoints in the order of their ids finds each sink's first endpoint and
    its first path together (``first_routes``); a node never holds more than one path per round, however many
    endpoints reach it. Without a path, an endpoint of the same file counts with less confidence.
    """
    whole = materialize(collapse_edges(edges), "match-edges")
    starts = whole.filter("src like 'ep%'").select(F.col("src").alias("source"), node_number(F.col("src")).alias("label")).distinct()
    routes = first_routes(whole, starts, sinks.select(F.concat(F.lit("sink_"), "sink_id").alias("target")), max_hops)
    proven = routes.select(
        node_number(F.col("source")).alias("endpoint_id"), node_number(F.col("target")).alias("sink_id"),
        "nodes", "hops", F.col("confidence").alias("reach"), "edge_types", F.lit(0).alias("rank"),
    )
    release(whole)
    if same_file:
        # The first endpoint of a file is one row, so a file with many of both forms no pairs.
        first = endpoints.groupBy("file_id").agg(F.min("endpoint_id").alias("endpoint_id"))
        source, target = F.concat(F.lit("ep_"), "endpoint_id"), F.concat(F.lit("sink_"), "sink_id")
        beside = sinks.select("sink_id", "file_id").join(first, "file_id").select(
            "endpoint_id", "sink_id", F.array(source, target).alias("nodes"), F.lit(1).alias("hops"), F.lit(SAME_FILE_CONFIDENCE).alias("reach"),
            F.array().cast("array<string>").alias("edge_types"), F.lit(1).alias("rank"),
        )
        options = proven.unionByName(beside)
        taken = F.min_by(F.struct("endpoint_id", "nodes", "hops", "reach", "edge_types"), F.struct("endpoint_id", "rank"))
        proven = options.groupBy("sink_id").agg(taken.alias("o")).select("sink_id", "o.*")
    return sinks.join(proven.drop("rank"), "sink_id", "left")
