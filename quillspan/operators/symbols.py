"""Symbols: flattening of editor symbol trees, order, adjacent duplicates, and queries by name or position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lines import cut, declaration_extent
from ..functions.positions import bytes_to_positions, editor_lines, position_to_byte
from ..functions.scalars import contains_position, digest
from ..schemas import SYMBOL_KINDS
from ..staging import staged

#: Bounds of one response: symbols found or kept, nesting, bytes of a name, a detail and a breadcrumb path, and of all candidates' strings.
LIMITS = {"nodes": 100_000, "depth": 256, "name_bytes": 4 << 10, "detail_bytes": 16 << 10, "path_bytes": 64 << 10, "storage_bytes": 64 << 20}
NUMBER_MAX = 2**31 - 1
WIRE_MAX = 2**32 - 1  #: what a number of the protocol can hold
PARTS = ("start_line", "start_character", "end_line", "end_character")
RANGE = f"struct<{','.join(f'{p}:int' for p in PARTS)}>"
FLAT = f"path string, ordinal long, depth int, name string, detail string, kind_number int, kind string, symbol_path array<string>, lsp_range {RANGE}, lsp_selection_range {RANGE}, start long, end long, selection_start long, selection_end long, problem string"


def _kind_of(node: Column, at: str) -> Column:
    """The type of a part of a tree; null where there is no such part."""
    return F.schema_of_variant(F.try_variant_get(node, at, "variant"))


def _whole_number(node: Column, at: str) -> Column:
    """A number of the protocol; null where there is none."""
    number = F.try_variant_get(node, at, "long")
    return F.when((_kind_of(node, at) == "BIGINT") & number.between(0, WIRE_MAX), number)


def _wire_range(node: Column, name: str) -> Column:
    """A range as it came; null where it is malformed."""
    parts = [_whole_number(node, f"$.{name}.{end}.{part}").alias(f"{end}_{part}") for end in ("start", "end") for part in ("line", "character")]
    made = F.struct(*parts)
    return F.when(F.coalesce(*(made[p] for p in PARTS)).isNotNull() & ~F.greatest(*(made[p].isNull() for p in PARTS)), made)


def _children(node: Column, at: str) -> Column:
    """The parts of an array, null where there is none (or a JSON null). Only the array is copied: a type would be that of all below it."""
    return F.try_variant_get(node, at, "array<variant>")


def _has(node: Column, at: str) -> Column:
    """Whether there is such a part, a JSON null too."""
    return F.try_variant_get(node, at, "variant").isNotNull()


def tree_nodes(responses: DataFrame) -> DataFrame:
    """Every node of the trees of ``responses(path, tree)``, a level at a time: its ``place`` (positions from the root on, so that arrays in order are
    the tree in pre-order), ``depth``, names so far, and its fields; ``malformed`` where it has not the shape of a symbol.

    Each level is one pass over what hangs below the level before, and written down. Levels end with the deepest tree, which parsing bounds.
    """
    node = F.col("node")
    fields = {
        "name": F.when(_kind_of(node, "$.name") == "STRING", F.try_variant_get(node, "$.name", "string")),
        "kind_number": F.when(_kind_of(node, "$.kind") == "BIGINT", F.try_variant_get(node, "$.kind", "int")),
        "detail": F.when(_kind_of(node, "$.detail") == "STRING", F.try_variant_get(node, "$.detail", "string")),
        "lsp_range": _wire_range(node, "range"),
        "lsp_selection_range": _wire_range(node, "selectionRange"),
        "below": _children(node, "$.children"),
    }
    other = F.try_variant_get(node, "$.children", "variant")
    # Looked at where there is no array alone.
    odd = F.when(F.col("below").isNull(), other.isNotNull() & ~F.coalesce(F.is_variant_null(other), F.lit(False))).otherwise(False)
    odd |= F.coalesce(~_kind_of(node, "$.detail").isin("STRING", "VOID"), F.lit(False))
    malformed = odd | F.col("name").isNull() | F.col("kind_number").isNull() | F.col("lsp_range").isNull() | F.col("lsp_selection_range").isNull()
    kept = ["path", "place", "depth", "symbol_path", "name", "detail", "kind_number", "lsp_range", "lsp_selection_range", "n_children", "malformed"]
    above = responses.select("path", F.lit(None).cast("array<int>").alias("place"), F.lit(0).alias("depth"), F.lit(None).cast("array<string>").alias("symbol_path"), _children(F.col("tree"), "$").alias("below"))
    levels = []
    while True:
        each = above.select("path", F.col("place").alias("up"), "depth", F.col("symbol_path").alias("names"), F.posexplode("below").alias("k", "node"))
        each = each.withColumns(fields).withColumn("malformed", malformed)
        nothing = F.array()
        level = each.select(
            "path",
            F.concat(F.coalesce("up", nothing.cast("array<int>")), F.array("k")).alias("place"),
            (F.col("depth") + 1).alias("depth"),
            F.concat(F.coalesce("names", nothing.cast("array<string>")), F.array(F.coalesce("name", F.lit("")))).alias("symbol_path"),
            *("name detail kind_number lsp_range lsp_selection_range".split()),
            F.coalesce(F.size("below"), F.lit(0)).alias("n_children"),
            "malformed",
            "below",
        )
        level = staged(level, "level", wide=True)
        levels.append(level.select(*kept))
        above = level.filter("n_children > 0").select("path", "place", "depth", "symbol_path", "below")
        if above.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def node_ranges(nodes: DataFrame, responses: DataFrame) -> DataFrame:
    """``path, place, ends``: of every node the bytes of its four positions, in order, with what is wrong with each."""
    ends = F.array(*(F.struct(F.lit(2 * k + j).alias("which"), F.col(c)[f"{end}_line"].cast("long").alias("line"), F.col(c)[f"{end}_character"].cast("long").alias("character")) for k, c in enumerate(("lsp_range", "lsp_selection_range")) for j, end in enumerate(("start", "end"))))
    every = nodes.filter(~F.col("malformed")).select("path", "place", F.inline(ends))
    # Each distinct position is converted once; a line may be asked for by many symbols.
    distinct = every.select("path", "line", "character").distinct().join(responses.select("path", "encoding"), "path")
    found = position_to_byte(distinct, editor_lines(responses)).select("path", "line", "character", "offset", "problem")
    met = every.join(found, ["path", "line", "character"])
    return met.groupBy("path", "place").agg(F.array_sort(F.collect_list(F.struct("which", "offset", "problem"))).alias("ends"))


def flatten(responses: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``responses(path, bytes, encoding, symbols)`` (JSON text) as rows in pre-order; every range is converted before any filter.

    A response that is refused gives one row with its first problem: that of its shape, then that of the first node in pre-order that has one. Nodes and
    ranges of all documents are told at once; what stands in order is one document's own, bounded by its limits.
    """
    bounds = LIMITS | (limits or {})
    tree = F.try_parse_json("symbols")
    given = staged(responses.select("path", "bytes", "encoding", "symbols").withColumn("tree", tree), "responses", wide=True)
    roots = _children(F.col("tree"), "$")
    torn = (
        F.when(F.col("symbols").isNull() | (F.col("symbols") == "") | F.is_variant_null("tree") | (F.size("roots") == 0), None)
        .when(F.col("tree").isNull() | F.col("roots").isNull(), "MALFORMED")
        .when(F.forall("roots", lambda x: _has(x, "$.location")), "FLAT_UNSUPPORTED")
        # A root that is no object has none of these.
        .when(~F.forall("roots", lambda x: _has(x, "$.range") & _has(x, "$.selectionRange")), "MALFORMED")
    )
    shaped = staged(given.withColumn("roots", roots).select("path", torn.alias("problem")), "shaped")
    good = given.join(shaped.filter("problem is null").select("path"), "path", "left_semi")
    nodes = staged(tree_nodes(good.select("path", "tree")), "nodes")
    placed = nodes.join(node_ranges(nodes, good.select("path", "bytes", "encoding")), ["path", "place"], "left")
    at = lambda k: F.get(F.col("ends"), F.lit(k))
    placed = placed.withColumns({"start": at(0)["offset"], "end": at(1)["offset"], "selection_start": at(2)["offset"], "selection_end": at(3)["offset"]})
    name, detail, path_bytes = F.octet_length("name"), F.coalesce(F.octet_length("detail"), F.lit(0)), F.aggregate("symbol_path", F.lit(0), lambda a, x: a + F.octet_length(x))
    upto = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("path").orderBy("place")
    first = F.count(F.when(F.col("depth") == 1, 1)).over(Window.partitionBy("path"))
    sums = {
        "ordinal": (F.row_number().over(order) - 1).cast("long"),
        "storage": F.sum(2 * name + detail + path_bytes).over(upto),
        "first": first,
        "seen": first + F.sum("n_children").over(upto),
    }
    wide = F.greatest(*(F.col(c)[p] > NUMBER_MAX for c in ("lsp_range", "lsp_selection_range") for p in PARTS))
    # In the order in which a node is looked at.
    problem = F.coalesce(
        F.when((F.col("first") > bounds["nodes"]) | (F.col("ordinal") >= bounds["nodes"]), "TOO_MANY"),
        F.when(F.col("depth") > bounds["depth"], "TOO_DEEP"),
        F.when((name == 0) | wide, "MALFORMED"),
        F.when(name > bounds["name_bytes"], "NAME_TOO_LONG"),
        F.when(detail > bounds["detail_bytes"], "DETAIL_TOO_LONG"),
        F.when(path_bytes > bounds["path_bytes"], "PATH_TOO_LONG"),
        at(0)["problem"],
        at(1)["problem"],
        F.when(F.col("start") >= F.col("end"), "INVALID_RANGE"),
        at(2)["problem"],
        at(3)["problem"],
        F.when(F.col("selection_start") >= F.col("selection_end"), "INVALID_RANGE"),
        F.when((F.col("selection_start") < F.col("start")) | (F.col("selection_end") > F.col("end")), "SELECTION_OUTSIDE"),
        F.when(F.col("storage") > bounds["storage_bytes"], "STORAGE_EXCEEDED"),
        F.when(F.col("seen") > bounds["nodes"], "TOO_MANY"),
    )
    judged = staged(placed.withColumns(sums).withColumn("problem", problem), "judged")
    # A response is read whole before it is walked through: a node of a wrong shape comes before all else.
    broken = judged.filter("malformed or problem is not null").groupBy("path").agg(F.bool_or("malformed").alias("broken"), F.min(F.when(F.col("problem").isNotNull(), F.struct("ordinal", "problem"))).alias("p"))
    broken = broken.select("path", F.when(F.col("broken"), "MALFORMED").otherwise(F.col("p.problem")).alias("problem")).filter("problem is not null")
    refused = shaped.filter("problem is not null").unionByName(broken)
    kinds = F.array(*map(F.lit, SYMBOL_KINDS))
    spelled = F.coalesce(F.get(kinds, F.when(F.col("kind_number").between(1, len(SYMBOL_KINDS)), F.col("kind_number") - 1)), F.lit("unknown"))
    rows = judged.join(broken.select("path"), "path", "left_anti").withColumn("kind", spelled)
    names = [x.split(" ")[0] for x in FLAT.replace(RANGE, "range").split(", ")]
    kept = rows.select(*(F.col(c).cast(RANGE).alias(c) if c.startswith("lsp") else F.col(c) for c in names))
    return kept.unionByName(refused.select("path", F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("depth"), "problem"), allowMissingColumns=True).select(*names)


#: The order of candidates; a missing detail comes first.
ORDER = ("start", "end", "kind", "kind_number", "symbol_path", "name", "selection_start", "selection_end")


def candidate_order() -> list[Column]:
    return [*map(F.col, ORDER), F.col("detail").asc_nulls_first(), F.col("ordinal")]


def distinct_adjacent(symbols: DataFrame) -> DataFrame:
    """Candidates in order, without those that equal the one right before them; ``place`` numbers the rest from 0."""
    by_path = Window.partitionBy("path").orderBy(*candidate_order())
    same = F.struct("lsp_range", "kind", "kind_number", "symbol_path", "name")
    kept = symbols.filter(F.col("problem").isNull()).withColumn("before", F.lag(same).over(by_path)).filter(F.col("before").isNull() | ~F.col("before").eqNullSafe(same)).drop("before")
    return kept.withColumn("place", F.row_number().over(by_path) - 1)


def by_name(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """``queries(query_id, path, name, kind)`` (a null kind is any) with every matching candidate: exact, case-sensitive."""
    q = queries.select("query_id", F.col("path").alias("q_path"), F.col("name").alias("q_name"), F.col("kind").alias("q_kind"))
    found = q.join(symbols.filter(F.col("problem").isNull()), (F.col("q_path") == F.col("path")) & (F.col("q_name") == F.col("name")))
    found = found.filter(F.col("q_kind").isNull() | ((F.col("q_kind") == F.col("kind")) & (F.col("kind") != "unknown")))
    order = Window.partitionBy("query_id").orderBy(*candidate_order())
    same = F.struct("lsp_range", "kind", "kind_number", "symbol_path", "name")
    kept = found.withColumn("before", F.lag(same).over(order)).filter(F.col("before").isNull() | ~F.col("before").eqNullSafe(same))
    return kept.drop("before", "q_path", "q_name", "q_kind")


BIN = 4096  #: bytes of a bin that positions and ranges meet in


def by_position(queries: DataFrame, symbols: DataFrame, smallest: bool = True, bin_bytes: int = BIN) -> DataFrame:
    """``queries(query_id, path, offset, length)`` with every candidate whose range holds the offset; ``smallest``: the shortest only.

    An equi-join on path and bin: a range goes into every bin that it touches, a position into its own, so no pair of the
    two meets twice and none is compared across documents.
    """
    q = queries.select("query_id", F.col("path").alias("q_path"), "offset", "length", F.floor(F.col("offset") / bin_bytes).alias("q_bin"))
    known = symbols.filter(F.col("problem").isNull()).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_bytes), F.floor(F.col("end") / bin_bytes))))
    found = q.join(known, (F.col("q_path") == F.col("path")) & (F.col("q_bin") == F.col("bin"))).filter(contains_position(F.col("start"), F.col("end"), F.col("offset"), F.col("length")))
    found = found.drop("bin", "q_bin", "q_path")
    if smallest:
        found = found.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("end") - F.col("start")))).filter("r = 1").drop("r")
    order = Window.partitionBy("query_id").orderBy(*candidate_order())
    same = F.struct("lsp_range", "kind", "kind_number", "symbol_path", "name")
    return found.withColumn("before", F.lag(same).over(order)).filter(F.col("before").isNull() | ~F.col("before").eqNullSafe(same)).drop("before")


def gate(found: DataFrame, queries: DataFrame, unique: bool, most: int = 1000, shown: int = 50) -> DataFrame:
    """``query_id, matches, problem, candidates``: too many, none or more than one (with the first ``shown``) of each query."""
    order = Window.partitionBy("query_id").orderBy(*candidate_order())
    ranked = found.withColumn("place", F.row_number().over(order))
    each = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("matches"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "name", "kind", "start", "end")))).alias("candidates"))
    every = queries.select("query_id").join(each, "query_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    if unique:
        problem = F.when(F.col("matches") == 0, "SELECTION_NOT_FOUND").when(F.col("matches") > 1, "SELECTION_AMBIGUOUS")
    else:
        problem = F.when(F.col("matches") > most, "LSP_RESOURCE_LIMIT_EXCEEDED")
    return every.select("query_id", "matches", problem.alias("problem"), "candidates")


def project_matches(found: DataFrame, files: DataFrame, whole_lines: bool = False) -> DataFrame:
    """Matches with the range to select, its digest and its length, and ``request_source``: the source of a request that takes it from the file as it
    is, in a request's own form."""
    src = files.select(F.col("path").alias("f_path"), "bytes", F.col("sha256").alias("f_sha256"))
    joined = found.join(src, F.col("path") == F.col("f_path")).withColumn("x", declaration_extent("bytes", F.col("start"), F.col("end")) if whole_lines else F.struct("start", "end"))
    start, end = F.col("x.start"), F.col("x.end")
    source = F.struct("path", F.struct(F.lit("bytes").alias("kind"), start.alias("start"), end.alias("end")).alias("selector"), F.struct(F.lit("sha256").alias("kind"), F.col("f_sha256").alias("value")).alias("precondition"))
    extent = F.lit("declaration_lines" if whole_lines else "symbol")
    return joined.select(*found.columns, extent.alias("extent"), start.alias("selected_start"), end.alias("selected_end"), (end - start).alias("selected_byte_length"), digest(cut("bytes", start, end)).alias("selected_payload_sha256"), source.alias("request_source"))


def with_lines(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows(path, start, end, ...)`` with the line and scalar column of both ends, from 1; the column is null behind a last terminator."""
    ends = rows.select("path", F.explode(F.array("start", "end")).alias("offset")).distinct()
    found = bytes_to_positions(ends, files).select("path", "offset", "line", "column")
    for end in ("start", "end"):
        own = found.select(F.col("path").alias("p"), F.col("offset").alias("o"), F.col("line").alias(f"{end}_line"), F.col("column").alias(f"{end}_column"))
        rows = rows.join(own, (F.col("path") == F.col("p")) & (F.col(end) == F.col("o")), "left").drop("p", "o")
    return rows


def outline(symbols: DataFrame, kinds: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """The outline of every document: ordered, adjacent duplicates gone, then filtered by kind; ``exceeded`` beyond ``most``."""
    kept = distinct_adjacent(symbols)
    if kinds:
        kept = kept.filter(F.col("kind").isin(*kinds))
    by_path = Window.partitionBy("path")
    return kept.select("path", F.row_number().over(by_path.orderBy("place")).alias("row"), "name", "kind", "symbol_path", (F.size("symbol_path") - 1).alias("level"), "detail", "start", "end", "lsp_range", "lsp_selection_range", (F.count(F.lit(1)).over(by_path) > most).alias("exceeded"))


def outline_text(rows: DataFrame) -> DataFrame:
    """``path, text``: a header and one indented line a symbol."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("kind"), F.lit(" "), F.col("name"))
    return rows.groupBy("path").agg(F.concat(F.col("path"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"))
