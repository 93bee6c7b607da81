"""Fixed schemas of landed records and prepared tables."""

# Column of the granule table <- key of the search hit, with its type.
HIT_COLUMNS = (
    ("GranuleUR", "granule-ur-lowercase", "string"),
    ("StartTime", "start-date", "string"),
    ("EndTime", "end-date", "string"),
    ("ConceptId", "concept-id", "string"),
    ("CollectionConceptId", "collection-concept-id", "string"),
    ("CoordinateSystem", "coordinate-system", "string"),
    ("DayNight", "day-night", "string"),
    ("EntryTitle", "entry-title", "string"),
    ("MetadataFormat", "metadata-format", "string"),
    ("NativeId", "native-id", "string"),
    ("ProviderId", "provider-id", "string"),
    ("ReadableGranuleNameSort", "readable-granule-name-sort", "string"),
    ("ShortNameLowercase", "short-name-lowercase", "string"),
    ("TwoDCoordName", "two-d-coord-name", "string"),
    ("VersionIdLowercase", "version-id-lowercase", "string"),
    ("UpdateTime", "update-time", "string"),
    ("CreatedAt", "created-at", "string"),
    ("ProductionDate", "production-date", "string"),
    ("RevisionDate", "revision-date", "string"),
    ("RevisionId", "revision-id", "int"),
    ("Size", "size", "double"),
    ("CloudCover", "cloud-cover", "double"),
    ("LRCrossesAntimeridian", "lr-crosses-antimeridian", "boolean"),
    ("LREast", "lr-east", "double"),
    ("LRNorth", "lr-north", "double"),
    ("LRSouth", "lr-south", "double"),
    ("LRWest", "lr-west", "double"),
    ("MBRCrossesAntimeridian", "mbr-crosses-antimeridian", "boolean"),
    ("MBREast", "mbr-east", "double"),
    ("MBRNorth", "mbr-north", "double"),
    ("MBRSouth", "mbr-south", "double"),
    ("MBRWest", "mbr-west", "double"),
)

_HIT_FIELDS = [f"`{key}`:{kind}" for _, key, kind in HIT_COLUMNS]
HIT_SOURCE_DDL = f"struct<{','.join(_HIT_FIELDS)},ords:array<bigint>,`ords-info`:array<int>>"
HIT_DOCUMENT_DDL = f"_index string, _id string, _source {HIT_SOURCE_DDL}"

GRANULE_COLUMNS = tuple(name for name, _, _ in HIT_COLUMNS) + ("geometry",)

_POINT = "struct<PointLongitude:double,PointLatitude:double>"
_LON_LAT = "struct<Longitude:double,Latitude:double>"
_EDGES = ",".join(f"{side}BoundingCoordinate:double" for side in ("West", "East", "North", "South"))
_DOMAIN = (
    "struct<HorizontalSpatialDomain:struct<Geometry:struct<"
    f"Point:array<{_LON_LAT}>,"
    f"Line:array<struct<Point:array<{_POINT}>>>,"
    f"BoundingRectangle:array<struct<{_EDGES}>>,"
    f"GPolygon:array<struct<Boundary:struct<Point:array<{_POINT}>>,CenterPoint:{_POINT}>>"
    ">>>"
)
ECHO10_DDL = (
    "GranuleUR string,"
    "Temporal struct<RangeDateTime:struct<BeginningDateTime:string,EndingDateTime:string>>,"
    f"SpatialExtent {_DOMAIN}, Spatial {_DOMAIN}"
)
