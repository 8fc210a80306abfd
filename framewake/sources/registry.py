"""The registry of metadata tags as a table, and typed values of items by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import imap_special

# Fixed values of the metadata standard: tag|name|kind|least octets|most octets|low|high|special
TAGS = """
1|Checksum|uint|2|2|||
2|Precision Time Stamp|timestamp|8|8|||
3|Mission ID|text|1|127|||
4|Platform Tail Number|text|1|127|||
5|Platform Heading Angle|mapped u|2|2|0|360|
6|Platform Pitch Angle|mapped s|2|2|-20|20|out_of_range
7|Platform Roll Angle|mapped s|2|2|-50|50|out_of_range
8|Platform True Airspeed|uint|1|1|||
9|Platform Indicated Airspeed|uint|1|1|||
10|Platform Designation|text|1|127|||
11|Image Source Sensor|text|1|127|||
12|Image Coordinate System|text|1|127|||
13|Sensor Latitude|mapped s|4|4|-90|90|reserved
14|Sensor Longitude|mapped s|4|4|-180|180|reserved
15|Sensor True Altitude|mapped u|2|2|-900|19000|
16|Sensor Horizontal Field of View|mapped u|2|2|0|180|
17|Sensor Vertical Field of View|mapped u|2|2|0|180|
18|Sensor Relative Azimuth Angle|mapped u|4|4|0|360|
19|Sensor Relative Elevation Angle|mapped s|4|4|-180|180|reserved
20|Sensor Relative Roll Angle|mapped u|4|4|0|360|
21|Slant Range|mapped u|4|4|0|5000000|
22|Target Width|mapped u|2|2|0|10000|
23|Frame Center Latitude|mapped s|4|4|-90|90|off_earth
24|Frame Center Longitude|mapped s|4|4|-180|180|off_earth
25|Frame Center Elevation|mapped u|2|2|-900|19000|
26|Offset Corner Latitude Point 1|mapped s|2|2|-0.075|0.075|off_earth
27|Offset Corner Longitude Point 1|mapped s|2|2|-0.075|0.075|off_earth
28|Offset Corner Latitude Point 2|mapped s|2|2|-0.075|0.075|off_earth
29|Offset Corner Longitude Point 2|mapped s|2|2|-0.075|0.075|off_earth
30|Offset Corner Latitude Point 3|mapped s|2|2|-0.075|0.075|off_earth
31|Offset Corner Longitude Point 3|mapped s|2|2|-0.075|0.075|off_earth
32|Offset Corner Latitude Point 4|mapped s|2|2|-0.075|0.075|off_earth
33|Offset Corner Longitude Point 4|mapped s|2|2|-0.075|0.075|off_earth
34|Icing Detected|uint|1|1|0|2|
35|Wind Direction|mapped u|2|2|0|360|
36|Wind Speed|mapped u|1|1|0|100|
37|Static Pressure|mapped u|2|2|0|5000|
38|Density Altitude|mapped u|2|2|-900|19000|
39|Outside Air Temperature|sint|1|1|||
40|Target Location Latitude|mapped s|4|4|-90|90|off_earth
41|Target Location Longitude|mapped s|4|4|-180|180|off_earth
42|Target Location Elevation|mapped u|2|2|-900|19000|
43|Target Track Gate Width|mapped u|1|1|0|510|
44|Target Track Gate Height|mapped u|1|1|0|510|
45|Target Error Estimate - CE90|mapped u|2|2|0|4095|
46|Target Error Estimate - LE90|mapped u|2|2|0|4095|
47|Generic Flag Data|uint|1|1|0|63|
48|Security Local Set|security|0||||
49|Differential Pressure|mapped u|2|2|0|5000|
50|Platform Angle of Attack|mapped s|2|2|-20|20|out_of_range
51|Platform Vertical Speed|mapped s|2|2|-180|180|out_of_range
52|Platform Sideslip Angle|mapped s|2|2|-20|20|out_of_range
53|Airfield Barometric Pressure|mapped u|2|2|0|5000|
54|Airfield Elevation|mapped u|2|2|-900|19000|
55|Relative Humidity|mapped u|1|1|0|100|
56|Platform Ground Speed|uint|1|1|||
57|Ground Range|mapped u|4|4|0|5000000|
58|Platform Fuel Remaining|mapped u|2|2|0|10000|
59|Platform Call Sign|text|1|127|||
60|Weapon Load|uint|2|2|||
61|Weapon Fired|uint|1|1|||
62|Laser PRF Code|uint|2|2|||
63|Sensor Field of View Name|uint|1|1|0|8|
64|Platform Magnetic Heading|mapped u|2|2|0|360|
65|UAS Datalink LS Version Number|uint|1|1|||
67|Alternate Platform Latitude|mapped s|4|4|-90|90|reserved
68|Alternate Platform Longitude|mapped s|4|4|-180|180|reserved
69|Alternate Platform Altitude|mapped u|2|2|-900|19000|
70|Alternate Platform Name|text|1|127|||
71|Alternate Platform Heading|mapped u|2|2|0|360|
72|Event Start Time|timestamp|8|8|||
73|RVT Local Set|rvt|0||||
74|VMTI Local Set|vmti|0||||
75|Sensor Ellipsoid Height|mapped u|2|2|-900|19000|
76|Alternate Platform Ellipsoid Height|mapped u|2|2|-900|19000|
77|Operational Mode|uint|1|1|0|5|
78|Frame Center Height Above Ellipsoid|mapped u|2|2|-900|19000|
79|Sensor North Velocity|mapped s|2|2|-327|327|out_of_range
80|Sensor East Velocity|mapped s|2|2|-327|327|out_of_range
81|Image Horizon Pixel Pack|horizon|1|20|||
82|Corner Latitude Point 1 (Full)|mapped s|4|4|-90|90|off_earth
83|Corner Longitude Point 1 (Full)|mapped s|4|4|-180|180|off_earth
84|Corner Latitude Point 2 (Full)|mapped s|4|4|-90|90|off_earth
85|Corner Longitude Point 2 (Full)|mapped s|4|4|-180|180|off_earth
86|Corner Latitude Point 3 (Full)|mapped s|4|4|-90|90|off_earth
87|Corner Longitude Point 3 (Full)|mapped s|4|4|-180|180|off_earth
88|Corner Latitude Point 4 (Full)|mapped s|4|4|-90|90|off_earth
89|Corner Longitude Point 4 (Full)|mapped s|4|4|-180|180|off_earth
90|Platform Pitch Angle (Full)|mapped s|4|4|-90|90|out_of_range
91|Platform Roll Angle (Full)|mapped s|4|4|-90|90|out_of_range
92|Platform Angle of Attack (Full)|mapped s|4|4|-90|90|out_of_range
93|Platform Sideslip Angle (Full)|mapped s|4|4|-180|180|out_of_range
94|MIIS Core Identifier|miis|1|50|||
95|SAR Motion Imagery Local Set|sar|0||||
96|Target Width Extended|imap|1|8|0|1500000|
97|Range Image Local Set|range_image|0||||
98|Geo-Registration Local Set|geo_registration|0||||
99|Composite Imaging Local Set|composite_imaging|0||||
100|Segment Local Set|segment|0||||
101|Amend Local Set|amend|0||||
102|SDCC-FLP|sdcc|0||||
103|Density Altitude Extended|imap|1|8|-900|40000|
104|Sensor Ellipsoid Height Extended|imap|1|8|-900|40000|
105|Alternate Platform Ellipsoid Height Extended|imap|1|8|-900|40000|
106|Stream Designator|text|1|127|||
107|Operational Base|text|1|127|||
108|Broadcast Source|text|1|127|||
109|Range To Recovery Location|imap|1|4|0|21000|
110|Time Airborne|uint|1|4|||
111|Propulsion Unit Speed|uint|1|4|||
112|Platform Course Angle|imap|1|8|0|360|
113|Altitude AGL|imap|1|4|-900|40000|
114|Radar Altimeter|imap|1|4|-900|40000|
115|Control Command|control_command|0||||
116|Control Command Verification List|command_verification|0||||
117|Sensor Azimuth Rate|imap|1|4|-1000|1000|
118|Sensor Elevation Rate|imap|1|4|-1000|1000|
119|Sensor Roll Rate|imap|1|4|-1000|1000|
120|On-board MI Storage Percent Full|imap|1|3|0|100|
121|Active Wavelength List|active_wavelengths|0||||
122|Country Codes|country_codes|0||||
123|Number of NAVSATs in View|uint|1|1|||
124|Positioning Method Source|uint|1|1|1|255|
125|Platform Status|uint|1|1|0|12|
126|Sensor Control Mode|uint|1|1|0|6|
127|Sensor Frame Rate Pack|frame_rate|1|16|||
128|Wavelengths List|wavelengths|0||||
129|Target ID|text|1|32|||
130|Airbase Locations|airbase_locations|1|24|||
131|Take-off Time|timestamp|1|8|||
132|Transmission Frequency|imap|1|4|1|99999|
133|On-board MI Storage Capacity|uint|1|4|||
134|Zoom Percentage|imap|1|4|0|100|
135|Communications Method|text|1|127|||
136|Leap Seconds|sint|1|4|||
137|Correction Offset|sint|1|8|||
138|Payload List|payload_list|0||||
139|Active Payloads|active_payloads|0||||
140|Weapons Stores|weapons_stores|0||||
141|Waypoint List|waypoint_list|0||||
142|View Domain|view_domain|0||||
"""
SCHEMA = "tag long, name string, kind string, least int, most int, low double, high double, special string"


def registry(spark: SparkSession, text: str = TAGS) -> DataFrame:
    """A row for each registered tag: tag, name, kind, least and most octets, low and high end of its domain, what its special code means."""
    parse = [int, str, str, int, int, float, float, str]
    lines = [[f(x) if x else None for f, x in zip(parse, line.split("|"))] for line in text.strip().splitlines()]
    return spark.createDataFrame(lines, SCHEMA)


def _unsigned(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")


def _signed(raw: Column) -> Column:
    n, u = F.octet_length(raw), _unsigned(raw)
    span = F.pow(F.lit(2.0), 8 * n).cast("decimal(20,0)")
    return F.when(F.substring(raw, 1, 1) >= F.lit(b"\x80"), u - span).otherwise(u)


def _imap(raw: Column, low: Column, high: Column) -> Column:
    """The number of mapped octets whose count and domain are columns; null for special codes."""
    n = F.octet_length(raw)
    bits = F.ceil(F.round(F.log2(high - low), 12))
    scale = F.pow(F.lit(2.0), 8 * n - 1 - bits)
    zero = F.when((low < 0) & (high > 0), scale * low - F.floor(scale * low)).otherwise(0.0)
    code, top = _unsigned(raw).cast("double"), F.pow(F.lit(2.0), 8 * n - 1)
    exact = F.round(F.log2(high - low), 12) == bits
    return F.when((code < top) | ((code == top) & exact), (code - zero) / scale + low)


def decode_fields(items: DataFrame, tags: DataFrame, raw: str = "raw") -> DataFrame:
    """Items (tag, ``raw``) with name, kind, num, txt, special and issue by the registry; unknown tags have null kinds.

    num: numbers of integer, mapped and timestamp kinds (timestamps in microseconds), as a double; exact: the integers as
    decimal(20,0); txt: text. special, apart from null and from numbers: unknown for no octets, or what the most negative
    code of a signed mapping means. issue: zero_length, where that isn't allowed; length; minimal, for an integer of
    variable length with needless octets; text; domain; special, for a code of a mapping that stands for no number. An
    issue never fails the rest. The registry is broadcast: it has a row for each tag of a standard.
    """
    r, n = F.col(raw), F.octet_length(raw)
    d = items.join(F.broadcast(tags), "tag", "left")
    kind, empty = F.col("kind"), F.octet_length(raw) == 0
    whole = F.when(kind.isin("uint", "timestamp"), _unsigned(r)).when(kind == "sint", _signed(r))
    signed = F.when(n <= 8, _signed(r))
    half = F.pow(F.lit(2.0), 8 * n - 1)
    steps = F.when(kind == "mapped s", F.when(F.col("special").isNotNull(), 2 * half - 2).otherwise(2 * half - 1)).otherwise(2 * half - 1)
    code = F.when(kind == "mapped s", signed.cast("double") + F.when(F.col("special").isNotNull(), half - 1).otherwise(half)).otherwise(_unsigned(r).cast("double"))
    most_negative = (kind == "mapped s") & F.col("special").isNotNull() & (signed.cast("double") == -half)
    mapped = F.when(~most_negative, F.col("low") + code * (F.col("high") - F.col("low")) / steps)
    fits = n.between(F.col("least"), F.coalesce("most", F.lit(1 << 30)))
    short = F.col("least") < F.col("most")
    second = F.coalesce(F.substring(r, 2, 1) >= F.lit(b"\x80"), F.lit(False))
    first = F.substring(r, 1, 1)
    needless = short & (n > 1) & F.when(kind == "sint", ((first == F.lit(b"\x00")) & ~second) | ((first == F.lit(b"\xff")) & second)).otherwise(first == F.lit(b"\x00"))
    plain = F.when(r == F.lit(b"\x00"), F.lit("")).otherwise(F.decode(r, "UTF-8"))
    good_text = F.is_valid_utf8(r.cast("string")) & ~F.coalesce(r.cast("string").rlike(r"[\x01-\x1F\x7F]|^\x00.|.\x00|^\s|\s$"), F.lit(False))
    outside = kind.isin("uint", "sint") & F.col("low").isNotNull() & ~whole.cast("double").between(F.col("low"), F.col("high"))
    issue = (
        F.when(kind.isNull(), None)
        .when(empty & F.col("tag").isin(1, 2, 65, 100, 101, 102), "zero_length").when(empty, None)
        .when(~fits, "length").when(kind.isin("uint", "sint", "timestamp") & needless, "minimal").when(outside, "domain")
        .when((kind == "text") & ~good_text, "text").when((kind == "imap") & _imap(r, F.col("low"), F.col("high")).isNull(), "special")
    )
    d = d.withColumn("issue", issue)
    ok = F.col("issue").isNull() & ~empty
    return d.select(
        *items.columns, "name", "kind",
        F.when(ok, F.when(kind == "imap", _imap(r, F.col("low"), F.col("high"))).when(kind.startswith("mapped"), mapped).otherwise(whole.cast("double"))).alias("num"),
        F.when(ok, whole).alias("exact"), F.when(ok & (kind == "text"), plain).alias("txt"),
        F.when(kind.isNotNull() & empty & F.col("issue").isNull(), "unknown").when(ok & most_negative, F.col("special")).alias("special"),
        F.when(F.col("issue") == "special", F.concat_ws(":", "issue", imap_special(r))).otherwise(F.col("issue")).alias("issue"),
    )
