"""Search-service logs: text lines -> parsed events -> one normalised row per request."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.functions import wkt as wkt_text
from granulake.functions.staging import chain, let, once

# Search endpoints in matching order; a longer name stands before its prefix.
ENDPOINTS = (
    "granules/timeline",
    "granules",
    "csw/collections",
    "collections",
    "provider_holdings",
    "autocomplete",
    "concepts",
    "humanizers",
    "tiles",
    "keywords",
    "tags",
    "variables",
    "legacy-services",
    "services",
    "tools",
    "subscriptions",
    "order-option-drafts",
    "grid-drafts",
    "variable-drafts",
    "grids",
    "data-quality-summary-drafts",
    "tool-drafts",
    "order-options",
    "data-quality-summaries",
    "collection-drafts",
    "service-drafts",
    "community-usage-metrics",
    "associate",
    "health",
    "clear-cache",
    "caches",
    "clear-scroll",
    "browse-scaler",
    "site/collections/directory",
    "site/docs",
    "site/",
)

# Result formats in matching order; the character before a name is not checked.
FORMATS = (
    "html",
    "json",
    "xml",
    "echo10",
    "iso",
    "iso19115",
    "dif",
    "dif10",
    "csv",
    "atom",
    "opendata",
    "kml",
    "stac",
    "native",
    "umm-json",
    "umm_json",
)

# Other time parameters, the first one present wins.
OTHER_TIMES = (
    "equator.crossing.date",
    "params.revision.date",
    "params.updated.since",
    "params.production.date",
    "params.created.at",
)

# What the dotted, lower-case name of a parameter holds ("^x" is the whole name).
NAMES = {
    "provider": ("^provider", "params.provider"),
    "sort_key": ("^sort.key", "params.sort.key"),
    "page_size": ("^page.size", "params.page.size", "params.pagesize"),
    "page_num": ("^page.num", "params.page.num"),
    "version": ("^version", "params.version"),
    "short_name": ("^short.name", "params.short.name"),
    "concept_id": (
        "^concept.id",
        "params.collectionconceptid",
        "params.concept.id",
        "params.collection.concept.id",
        "params.echo.collection.id",
    ),
    "instrument": ("^instrument", "params.instrument"),
    "polygon": ("params.polygon",),
    "bbox": ("boundingbox", "bounding.box"),
    "circle": ("circle",),
    "line": ("params.line",),
    "point": ("params.point",),
    "grid": ("two.d.coordinate.system.name",),
    "orbit": ("params.orbit.number",),
    "cycle": ("params.cycle", "params.pass"),
}

# Client name pattern -> product.
CLIENT_GROUPS = (
    ("asf_search", "ASF Search"),
    ("eed-edsc", "Earthdata Search"),
    ("eed-mmt", "MMT"),
    ("AppEEARS", "AppEEARS"),
    ("CMR2IMS", "CMR2IMS"),
    ("cmr-stac", "cmr-stac"),
)

# Columns of the log table.
LOG_COLUMNS = (
    "now",
    "status",
    "method",
    "client_id",
    "request_id",
    "uri",
    "duration",
    "concept",
    "format",
    "user_agent_type",
    "used_search_after",
    "time_query",
    "time_type",
    "provider",
    "sort_key",
    "page_size",
    "page_num",
    "version",
    "short_name",
    "concept_id",
    "instrument",
    "wkt",
    "geo_type",
    "circle_radius",
    "error",
)

SEARCH_AFTER = "cmr-search-after"

PARAMS_DDL = "array<struct<name:string,text:string,items:array<string>>>"


# ---- lines -----------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Log text, plain or gzip, one row per line."""
    return spark.read.text(path)


def events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines holding REPORT whose `{...}` part is valid JSON, parsed once as `event`."""
    reports = lines.where(F.col(column).contains("REPORT"))
    document = F.try_parse_json(F.regexp_extract(column, r"\{.*\}", 0))
    return once(reports, "event", document, keep_null=False).drop(column)


def shapefile_uploads(spark: SparkSession, path, service: str, marker: str = "{:shapefile {:filename") -> DataFrame:
    """Lines holding both markers, counted per directory."""
    lines = spark.read.text(path).where(F.col("value").contains(service) & F.col("value").contains(marker))
    parts = F.split(F.col("_metadata.file_path"), "/")
    return lines.groupBy(F.get(parts, F.size(parts) - 2).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


# ---- parameters ------------------------------------------------------------------------------


# Top-level fields of an event that are no parameters.
EVENT_FIELDS = (
    "now",
    "status",
    "method",
    "client-id",
    "request-id",
    "uri",
    "user-agent",
    "duration",
    "query-params",
    "form-params",
    SEARCH_AFTER,
)


def _flatten(value: Column, prefix: Column, depth: int, skip: tuple[str, ...] = ()) -> Column:
    """Entries (name, text, items) of an object, nested objects included down to `depth`."""

    def as_map(v):
        return F.try_variant_get(v, "$", "map<string,variant>")

    def read(e):
        # text first: only values that look like a list or an object are looked at again
        return F.struct(
            F.lower(F.concat(prefix, F.regexp_replace(e["key"], "[^A-Za-z0-9]", "."))).alias("name"),
            F.try_variant_get(e["value"], "$", "string").alias("text"),
            e["value"].alias("value"),
        )

    def sort(e):
        items = F.when(e["text"].startswith("["), F.try_variant_get(e["value"], "$", "array<string>"))
        nested = F.when(e["text"].startswith("{"), as_map(e["value"]))
        return F.struct(*[e[n].alias(n) for n in ("name", "text", "value")], items.alias("items"), nested.isNotNull().alias("nested"))

    def entry(e):
        text = F.when(e["items"].isNull(), e["text"])
        leaf = F.array(F.struct(e["name"].alias("name"), text.alias("text"), e["items"].alias("items")))
        if depth == 0:
            return F.when(~e["nested"], leaf)
        inner = _flatten(e["value"], F.concat(e["name"], F.lit(".")), depth - 1)
        return F.when(e["nested"], inner).otherwise(leaf)

    listed = F.map_entries(as_map(value))
    if skip:
        listed = F.filter(listed, lambda e: ~e["key"].isin(*skip))
    none = F.array().cast(PARAMS_DDL)
    sorted_out = F.transform(F.transform(listed, read), sort)
    return F.flatten(F.transform(sorted_out, lambda e: F.coalesce(entry(e), none)))


def with_fields(parsed: DataFrame) -> DataFrame:
    """Top-level fields of the parsed event."""

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("event", f"$['{name}']", kind)

    return parsed.withColumns(
        {
            "now": field("now"),
            "status": field("status", "int"),
            "method": field("method"),
            "client_id": field("client-id"),
            "request_id": field("request-id"),
            "uri": field("uri"),
            "user_agent": field("user-agent"),
            "duration": field("duration", "double"),
            "used_search_after": field(SEARCH_AFTER).isNotNull(),
        }
    )


def with_params(parsed: DataFrame) -> DataFrame:
    """`params`: every parameter with its dotted name and its text or items.

    Order is top level, query parameters, form parameters; NULLs and empty lists are left out.
    """
    from pyspark import SparkContext

    return once(parsed, PARAMS, _params(id(SparkContext._gateway)))


@lru_cache(maxsize=2)
def _params(gateway: int) -> Column:
    def group(value: Column, prefix: str, depth: int) -> Column:
        return F.coalesce(_flatten(value, F.lit(prefix), depth, EVENT_FIELDS if not prefix else ()), F.array().cast(PARAMS_DDL))

    def part(name: str) -> Column:
        return F.try_variant_get("event", f"$['{name}']", "variant")

    everything = F.concat(
        group(F.col("event"), "", 0),
        group(part("query-params"), "query.params.", 2),
        group(part("form-params"), "form.params.", 2),
    )
    return F.filter(everything, lambda p: p["text"].isNotNull() | (F.size(p["items"]) > 0))


PARAMS = "params"


def _matching(names: Sequence[str], params: Column | str = PARAMS) -> Column:
    def named(p):
        tests = [p["name"] == n[1:] if n.startswith("^") else p["name"].contains(n) for n in names]
        return reduce(lambda a, b: a | b, tests)

    return F.filter(params, named)


def first_param(names: Sequence[str], joiner: str = ",", params: Column | str = PARAMS) -> Column:
    """First value among the matching parameters, single values before lists."""

    def pick(found):
        single = F.filter(found, lambda p: p["items"].isNull())
        listed = F.filter(found, lambda p: p["items"].isNotNull())
        return F.coalesce(
            F.get(single, F.lit(0))["text"], F.array_join(F.get(listed, F.lit(0))["items"], joiner)
        )

    return let(_matching(names, params), pick)


def all_params(names: Sequence[str], joiner: str = ";") -> Column:
    """All matching values as one text, single values before lists (a list joined by commas)."""
    found = _matching(names)
    single = F.transform(F.filter(found, lambda p: p["items"].isNull()), lambda p: p["text"])
    listed = F.transform(F.filter(found, lambda p: p["items"].isNotNull()), lambda p: F.array_join(p["items"], ","))
    return F.array_join(F.concat(single, listed), joiner)


# ---- columns of the log table ------------------------------------------------------------------


def uri_concept(uri: Column) -> Column:
    """Endpoint of a request."""
    alternatives = "|".join(f"/search/{e}" for e in ENDPOINTS)

    def endpoint(u):
        matched = F.nullif(F.regexp_extract(u, f"({alternatives})", 1), F.lit(""))
        return F.coalesce(matched, u)

    def php(name):
        return F.when(name.rlike(r"(?i)\.php"), "PHP requests").otherwise(name)

    def default(name):
        return F.when(name.isin("/search", "/search/"), "search/").otherwise(name)

    def shorter(name):
        longer = name.contains("/search/") & (F.length(name) > 8)
        return F.when(longer, F.split_part(name, F.lit("/search/"), F.lit(2))).otherwise(name)

    def data(name):
        kept = F.concat(F.substring_index(name, "daacdata", 1), F.lit("daacdata"))
        return F.when(name.contains("daacdata"), kept).otherwise(name)

    return chain(uri, endpoint, php, default, shorter, data)


def uri_format(uri: Column) -> Column:
    """Extension of the last path part; NULL when it is none of the known formats."""
    last = F.substring_index(uri, "/", -1)
    matched = F.regexp_extract(last, "(" + "|".join(f".{name}" for name in FORMATS) + ")", 1)
    return let(matched, lambda m: F.when(m.startswith("."), F.substring(m, 2, 100)))


def user_agent_type(agent: Column) -> Column:
    """Kind of client: the name before the first slash or bracket, with common kinds grouped."""
    start = F.substring_index(F.substring_index(F.substring(agent, 1, 80), "/", 1), "(", 1)

    def named(pattern, label):
        return lambda name: F.when(name.rlike(pattern), label).otherwise(name)

    return chain(
        start,
        named("podaac-subscriber", "podaac-subscriber"),
        lambda name: F.get(F.split(name, r" v[0-9]"), F.lit(0)),
        named("[B|b]ot", "Bot"),
        named("[P|p]ython|PycURL", "Python"),
        named("[M|m]ozilla", "Web Browser"),
    )


def _whole_number(text: Column) -> Column:
    number = F.trim(text).try_cast("double")
    return let(number, lambda n: F.when(F.abs(n) <= 2147483647, n.cast("int")))


def provider() -> Column:
    start = F.substring_index(F.substring_index(first_param(NAMES["provider"]), '"', 1), "'", 1)
    return let(start, lambda name: F.when(name.rlike("[^a-zA-Z0-9_]"), "INVALID").otherwise(name))


def version() -> Column:
    def checked(text):
        bad = ~text.contains("Near-Real-Time") & text.rlike("[^a-zA-Z0-9_.,]")
        return F.when(bad, "INVALID").otherwise(text)

    return let(first_param(NAMES["version"]), checked)


def facet_date(params: Column | str = PARAMS) -> Column:
    """Year, month and day facets as Y-M-D, without missing tails."""

    def part(unit):
        mine = F.filter(params, lambda p: p["name"].contains("params.temporal.facet") & p["name"].contains(unit))
        return F.coalesce(first_param(("params.temporal.facet",), params=mine), F.lit("NA"))

    text = F.concat_ws("-", part("year"), part("month"), part("day"))
    return let(text, lambda t: F.when(t != "NA-NA-NA", F.substring_index(t, "-NA", 1)))


def time_query() -> Column:
    """Struct (query, type): temporal parameters (the last present wins), facets, then the others."""
    labels = ["params.temporal", "params.temporal.facet", *OTHER_TIMES]

    def value(found):
        text = lambda p: F.coalesce(p["text"], F.array_join(p["items"], ";"))
        return let(F.get(found, F.lit(0)), text)

    def named(name):
        return lambda p: p["name"] == name

    def collect(params):
        # most requests have few time parameters: look at those only
        names = ("form.params.temporal..", "form.params.temporal", "query.params.temporal..", "query.params.temporal")
        exact = [value(F.filter(params, named(n))) for n in names]
        found = [F.coalesce(*exact), facet_date(params), *[value(_matching((o,), params)) for o in OTHER_TIMES]]
        return F.when(F.size(params) > 0, F.struct(*[v.alias(f"v{i}") for i, v in enumerate(found)]))

    def choose(v):
        kind = F.lit(None).cast("string")
        for i, label in reversed(list(enumerate(labels))):
            kind = F.when(v[f"v{i}"].isNotNull(), label).otherwise(kind)
        return F.struct(F.coalesce(*[v[f"v{i}"] for i in range(len(labels))]).alias("query"), kind.alias("type"))

    some = ("params.temporal", *OTHER_TIMES)
    return chain(_matching(some), collect, choose)


def _texts(param: Column) -> Column:
    return F.coalesce(param["items"], F.when(param["text"].isNotNull(), F.array(param["text"])))


# Order in which shape parameters are looked at.
SHAPE_ORDER = ("POLYGON", "BBOX", "CIRCLE", "LINESTRING", "POINT")


def spatial_query(literal: bool = False) -> Column:
    """Struct (wkt, geo_type, circle_radius, error).

    Polygon, box, circle, line, point in this order; the first present wins. `literal` lets a
    circle replace a polygon or a box. Grid, orbit and cycle/pass only name the type.
    """

    def first(params, name, use):
        return let(F.get(_matching(NAMES[name], params), F.lit(0)), use)

    def simple(geo_type):
        def text(one):
            single = wkt_text.scalar_text_to_wkt(one["text"], geo_type)
            return F.when(one["items"].isNull(), single).otherwise(wkt_text.list_text_to_wkt(one["items"], geo_type))

        return text

    def collect(params):
        # requests without any shape parameter stop here
        tag = F.lit(None).cast("string")
        for name, label in (("cycle", "cycle/pass"), ("orbit", "orbit"), ("grid", "2D Grid")):
            tag = F.when(F.size(_matching(NAMES[name], params)) > 0, label).otherwise(tag)
        found = F.struct(
            first(params, "polygon", simple("POLYGON")).alias("POLYGON"),
            first(params, "bbox", lambda one: wkt_text.boxes_to_wkt(_texts(one))).alias("BBOX"),
            first(params, "circle", lambda one: wkt_text.circles(_texts(one))).alias("circle"),
            first(params, "line", simple("LINESTRING")).alias("LINESTRING"),
            first(params, "point", simple("POINT")).alias("POINT"),
            tag.alias("tag"),
        )
        return F.when(F.size(params) > 0, found)

    def choose(v):
        ordered = [(v["circle"]["wkt"] if n == "CIRCLE" else v[n], n) for n in SHAPE_ORDER]
        if literal:
            ordered.insert(0, ordered.pop(SHAPE_ORDER.index("CIRCLE")))
        kind = v["tag"]
        for value, label in reversed(ordered):
            kind = F.when(value.isNotNull(), label).otherwise(kind)
        radius = v["circle"]["radius"]
        return F.struct(
            F.coalesce(*[value for value, _ in ordered]).alias("text"), kind.alias("kind"), radius.alias("radius")
        )

    def finish(v):
        failed = v["text"].contains("ERROR")
        return F.struct(
            F.when(~failed, v["text"]).alias("wkt"),
            v["kind"].alias("geo_type"),
            F.when(v["kind"] == "CIRCLE", v["radius"]).alias("circle_radius"),
            F.when(failed, v["text"]).alias("error"),
        )

    shape_names = ("polygon", "bbox", "circle", "line", "point", "grid", "orbit", "cycle")
    some = [name for kind in shape_names for name in NAMES[kind]]
    return chain(_matching(some), collect, choose, finish)


def _expressions(literal: bool) -> dict[str, Column]:
    """Column expressions of the log table over `uri`, `user_agent` and `params`.

    They are the same for every table and made of thousands of nodes, so they are built once per
    gateway to the JVM.
    """
    from pyspark import SparkContext

    return _built_expressions(id(SparkContext._gateway), literal)


@lru_cache(maxsize=4)
def _built_expressions(gateway: int, literal: bool) -> dict[str, Column]:
    return {
        "_time": time_query(),
        "_space": spatial_query(literal),
        "concept": uri_concept(F.col("uri")),
        "format": uri_format(F.col("uri")),
        "user_agent_type": user_agent_type(F.col("user_agent")),
        "provider": provider(),
        "sort_key": first_param(NAMES["sort_key"]),
        "page_size": _whole_number(first_param(NAMES["page_size"])),
        "page_num": _whole_number(first_param(NAMES["page_num"])),
        "version": version(),
        "short_name": first_param(NAMES["short_name"]),
        "concept_id": first_param(NAMES["concept_id"]),
        "instrument": first_param(NAMES["instrument"]),
    }


def log_table(lines: DataFrame, column: str = "value", literal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text lines -> the log table, in one pass of native expressions; every line is parsed once.

    `keep` names extra columns of `lines` to carry along.
    """
    built = dict(_expressions(literal))
    fields = with_params(with_fields(events(lines, column)))
    staged = once(once(fields, "_time", built.pop("_time")), "_space", built.pop("_space"))
    unpacked = {
        "time_query": F.col("_time.query"),
        "time_type": F.col("_time.type"),
        **{name: F.col(f"_space.{name}") for name in ("wkt", "geo_type", "circle_radius", "error")},
    }
    return staged.withColumns({**built, **unpacked}).select(*keep, *LOG_COLUMNS)


# ---- labels ------------------------------------------------------------------------------------


def client_group(client: Column) -> Column:
    """Client ids of one product under its name."""

    def grouped(pattern, product):
        return lambda name: F.when(name.rlike(f"(?i){pattern}"), product).otherwise(name)

    return chain(client, *[grouped(*rule) for rule in CLIENT_GROUPS])


def time_type_label(time_type: Column) -> Column:
    has_prefix = time_type.contains("params.")
    return F.when(has_prefix, F.split_part(time_type, F.lit("params."), F.lit(2))).otherwise(time_type)
