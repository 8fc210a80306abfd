"""Moving-target sets: their fields, and their series of targets as item tables with typed values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .klv import _ber, _oid
from .metadata import _spread

# Fixed values of the moving-target standard: tag|name|kind|least octets|most octets|low|high|special
SET_TAGS = """
1|Checksum|uint|2|2|||
2|Precision Time Stamp|timestamp|8|8|||
3|System Name|text|1|128|||
4|Version|uint|1|2|1|65535|
5|Total Targets Detected|uint|1|3|||
6|Targets Reported|uint|1|3|||
8|Frame Width|uint|1|3|1|16777215|
9|Frame Height|uint|1|3|1|16777215|
10|Source Sensor|text|1|512|||
11|Horizontal Field of View|imap|2|2|0|180|
12|Vertical Field of View|imap|2|2|0|180|
13|Core Identifier|miis|2||||
101|Target Series|targets|1||||
102|Algorithm Series|algorithms|0||||
103|Ontology Series|ontologies|0||||
"""
TARGET_TAGS = """
1|Centroid|uint|1|6|1|281474976710655|
2|Box Top Left|uint|1|6|1|281474976710655|
3|Box Bottom Right|uint|1|6|1|281474976710655|
4|Priority|uint|1|1|1|255|
5|Confidence|uint|1|1|0|100|
6|History|uint|1|2|||
7|Percentage of Target Pixels|uint|1|1|1|100|
8|Color|rgb|3|3|||
9|Intensity|uint|1|3|||
10|Location Offset Latitude|imap|3|3|-19.2|19.2|
11|Location Offset Longitude|imap|3|3|-19.2|19.2|
12|Height|imap|2|2|-900|19000|
13|Box Top Left Latitude Offset|imap|3|3|-19.2|19.2|
14|Box Top Left Longitude Offset|imap|3|3|-19.2|19.2|
15|Box Bottom Right Latitude Offset|imap|3|3|-19.2|19.2|
16|Box Bottom Right Longitude Offset|imap|3|3|-19.2|19.2|
17|Location|location|10|22|||
18|Contour Series|locations|1||||
19|Centroid Row|uint|1|4|1|4294967295|
20|Centroid Column|uint|1|4|1|4294967295|
22|Algorithm|uint|1|3|||
23|Detection Status|uint|1|1|0|4|
101|Mask|set|1||||
104|Tracker|set|1||||
105|Chip|set|1||||
106|Chip Series|series|1||||
"""


def _targets(data: bytes) -> list[tuple]:
    found, ids, at = [], set(), 0
    while at < len(data):
        target = None
        try:
            size, start = _ber(data, at)
            at = start + size
            if at > len(data):
                raise ValueError("truncated")
            pack = data[start:at]
            target, k = _oid(pack, 0)
            if k > 9:
                raise ValueError("identifier")
            if k == len(pack) or target in ids:
                found.append((target, None, None, "no_items" if k == len(pack) else "repeated_target"))
                continue
            ids.add(target)
            seen = set()
            while k < len(pack):
                tag, (size, start) = pack[k], _ber(pack, k + 1)
                if tag > 127 or start + size > len(pack):
                    raise ValueError("item")
                found.append((target, tag, pack[start : start + size], "repeated_item" if tag in seen else None))
                seen.add(tag)
                k = start + size
        except (IndexError, ValueError):
            return [*found, (target, None, None, "malformed")]
    return found or [(None, None, None, "no_targets")]


def target_items(df: DataFrame, raw: str) -> DataFrame:
    """A series of targets to a row for each item: the row's other columns, target_id, tag, raw, target_issue.

    Issues: no_targets; no_items and repeated_target, of a target, whose items are left out; repeated_item; malformed, which
    ends the series.
    """
    kept = df.withColumnRenamed(raw, "__series")
    return _spread(kept, "__series", _targets, ["target_id", "tag", "raw", "target_issue"], [pa.int64(), pa.int64(), pa.binary(), pa.string()], "target_id long, tag long, raw binary, target_issue string")


def pivot_targets(values: DataFrame, keys: list[str], names: dict[str, int]) -> DataFrame:
    """A row for each target: keys, target_id, the numbers of the named tags, and how many issues it has."""
    one = [F.max(F.when(F.col("tag") == tag, F.col("num"))).alias(name) for name, tag in names.items()]
    return values.where("target_id is not null").groupBy(*keys, "target_id").agg(*one, F.count_if(F.col("issue").isNotNull() | F.col("target_issue").isNotNull()).alias("issues"))
