"""The verifier's rules as a table: what is wrong with a row of each kind, and what that says of a whole stream.

A rule is a row: scope, status, code, requirement and a predicate over the columns of its scope, in SQL. All rules of a
scope are compiled to one array expression, so a table of observations is scanned once however many rules there are. Summary
rules then decide from what was found, and from what there was to look at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed names: scope; status; code; requirement; predicate
RULES = """
packet; ERROR; transport.structure; ; structure IS NOT NULL
packet; WARNING; transport.duplicate; ; continuity = 'duplicate'
packet; ERROR; transport.continuity; ISO/IEC 13818-1 continuity_counter; continuity = 'error'
packet; WARNING; transport.scrambled; ; scrambling > 0
section; ERROR; psi.structure; ETSI EN 300 468; issue IS NOT NULL AND issue <> 'crc'
section; ERROR; psi.crc; ETSI EN 300 468 CRC_32; issue = 'crc'
section; ERROR; st1402.psi.pat.interval; ST 1402-02; table_name = 'PAT' AND overdue
section; ERROR; st1402.psi.pmt.interval; ST 1402-02; table_name = 'PMT' AND overdue
clock; ERROR; st1402.pcr.interval; ST 1402 7.2; issue = 'interval'
clock; ERROR; st1402.pcr.regression; ST 1402 7.2; issue = 'regression'
clock; ERROR; st1402.pcr.missing; ST 1402 7.2; expected AND ticks IS NULL
map; ERROR; st1402.metadata.metadata_descriptor; ST 1402; issue = 'metadata_descriptor'
map; ERROR; st1402.metadata.metadata_format_identifier; ST 1402; issue = 'metadata_format_identifier'
map; ERROR; st1402.metadata.metadata_service_id_duplicate; ST 1402; issue = 'metadata_service_id_duplicate'
map; ERROR; st1402.metadata.metadata_std_descriptor_count; ST 1402; issue = 'metadata_std_descriptor_count'
map; ERROR; st1402.metadata.registration_descriptor; ST 1402; issue = 'registration_descriptor'
map; ERROR; misp.security.multiple_carriage; MISP-2015.1-49; carriages > 1
map; ERROR; misp.video.codec; MISP-2019.1 3.6.3.1; kind = 'video' AND stream_type NOT IN (2, 27, 36)
map; ERROR; st1001.stream_type; ST 1001; kind = 'audio' AND stream_type NOT IN (3, 4, 15)
pes; ERROR; transport.decode; ; issue IS NOT NULL
pes; ERROR; st1402.pts.interval; ST 1402 7.3; pts_issue = 'interval'
pes; ERROR; st1402.pts.missing; ST 1402 7.3; pts_issue = 'missing'
pes; ERROR; st1402.pts.regression; ST 1402 7.3; pts_issue = 'regression'
pes; ERROR; st1402.pts.first_access_unit; H.222.0 2.7.5; pts_issue = 'first_access_unit'
pes; ERROR; st1402.metadata_delay.exceeded; ST 1402-12; delay = 'exceeded'
pes; ERROR; st1402.metadata_delay.negative; ST 1402-12; delay = 'negative'
pes; WARNING; st1402.metadata_delay.indeterminate; ST 1402-12; delay = 'indeterminate'
pes; WARNING; st1402.metadata_delay.unverifiable; ST 1402-12; delay = 'unverifiable'
pes; ERROR; st1001.audio.frame; ST 1001.1; kind = 'audio' AND frame_issue IS NOT NULL
pes; ERROR; st1001.audio.empty; ST 1001.1; kind = 'audio' AND frames = 0
video; ERROR; video.properties.decode; H.262 / H.264 / H.265 sequence syntax; issue IS NOT NULL
video; ERROR; misp.video.progressive; MISP-2015.1-02; NOT progressive
video; WARNING; misp.video.progressive_unverifiable; MISP-2015.1-02; issue IS NULL AND progressive IS NULL
video; ERROR; misp.video.profile_level; MISP-2018.2-113/-114/-115; NOT profile_ok
video; ERROR; video.h262.frame_rate_extension; H.262 Table E.3; NOT extension_ok
video; ERROR; video.h262.bit_rate; H.262 Table 8-13; NOT bits_ok
video; ERROR; video.h262.vbv_buffer_size; H.262 Table 8-14; NOT buffer_ok
video; ERROR; video.h262.chroma_format; H.262 Table 8-5; NOT chroma_ok
video; ERROR; video.h262.constrained_parameters; H.262 Table E.2; NOT constrained_ok
video; ERROR; video.level.picture_size; level limits; NOT size_ok
video; ERROR; video.level.sample_rate; level limits; NOT rate_ok
video; ERROR; misp.image.source_aspect_ratio; MISP-2015.1-01; aspect_num * 4 < aspect_den OR aspect_num > aspect_den * 4
stamp; ERROR; st0604.timestamp.decode; ST 0604.6; issue = 'decode'
stamp; ERROR; st0604.timestamp.missing; MISP-2018.1-104; issue = 'missing'
stamp; ERROR; st0604.timestamp.duplicate; MISP-2018.1-104; issue = 'duplicate'
stamp; ERROR; st0604.timestamp.unassociated; ST 0604.6; issue = 'unassociated'
stamp; WARNING; st0604.timestamp.lock_unknown; ST 0603.5 7.4; NOT locked
stamp; ERROR; st0603.timestamp.order; ST 0603.5 6; ns <= before AND NOT (ns < before AND discontinuity AND reverse)
stamp; WARNING; st0603.timestamp.discontinuity; ST 0603.5 7.4; discontinuity
metadata; ERROR; metadata.decode; ; issue IS NOT NULL
metadata; WARNING; metadata.unknown_key; ; NOT known_key
metadata; ERROR; st0601.field; ST 0601; bad_fields > 0
metadata; WARNING; st0601.target_elevation.datum_unknown; ST 0601.19 8.42.1; datum_unknown
metadata; WARNING; st0601.timestamp.regression; ST 0601; ts < ts_before
metadata; ERROR; st0902.missing; ST 0902.3-03; requirement = 'missing'
metadata; ERROR; st0902.overdue; ST 0902.3-04; requirement = 'overdue'
metadata; ERROR; st0902.zero_length; ST 0902.8-05; requirement = 'zero_length'
metadata; ERROR; st0902.exclusive_or; ST 0902.8 Note 1; requirement = 'exclusive_or'
metadata; ERROR; st0902.invalid_field; ST 0902.8; requirement = 'invalid_field'
state; ERROR; st1607.state; ST 1607.2 receiver state; branch IS NOT NULL
state; ERROR; st0601.wavelength.reserved; ST 0601.19 8.128; reference = 'reserved'
state; ERROR; st0601.wavelength.undefined; ST 0601.19 8.128; reference = 'undefined'
state; ERROR; st0601.payload.payload_count_changed; ST 0601.19 8.138; payload = 'count'
state; ERROR; st0601.payload.undefined_active_payload; ST 0601.17-39; payload = 'undefined'
state; ERROR; st0601.waypoint.historical_order_not_decreasing; ST 0601.17-40; waypoint = 'historical_not_decreasing'
state; ERROR; st0601.command.unmatched_acknowledgement; ST 0601.19 8.116; command = 'unmatched'
state; ERROR; st0601.command.changed_before_acknowledgement; ST 0601.19 8.115; command = 'changed'
state; ERROR; st0903.lifecycle.invalid_transition; ST 0903.6 7.2; target = 'invalid_transition'
state; ERROR; st0903.lifecycle.retired_reused; ST 0903.6-129; target = 'retired_reused'
state; WARNING; st0903.lifecycle.missing_status; ST 0903.6 7.2; target = 'missing_status'
"""

# Fixed names: code; requirement; scope whose rows are the evidence; what blocks it (error CODE, errors PREFIX*, any status ANY PREFIX*);
# the status where there is no evidence
SUMMARY = """
transport.structure; ; packet; transport.structure; -
transport.continuity; ISO/IEC 13818-1 continuity_counter; packet; transport.continuity; -
psi.pat; ISO/IEC 13818-1 PAT; section; psi.*; ERROR
psi.pmt; ISO/IEC 13818-1 PMT; map; psi.*; ERROR
fmv.video; ; video; video.properties.decode; ERROR
fmv.klv; ST 1402 metadata carriage; metadata; metadata.decode; ERROR
st1402.metadata; ST 1402.2; map; st1402.metadata.*; -
st1402.pcr; ST 1402 7.2; clock; st1402.pcr.*; -
st1402.pts; ST 1402 7.3; pes; st1402.pts.*; -
st1402.metadata_delay; ST 1402-12; pes; ANY st1402.metadata_delay.*; -
metadata.decode; ; metadata; metadata.decode; -
video.properties.syntax; sequence syntax; video; video.properties.decode; -
misp.video.progressive; MISP-2015.1-02; video; ANY misp.video.progressive*; -
misp.security.carriage; MISP-2015.1-49; map; misp.security.*; -
st0604.timestamp.syntax; MISP-2018.1-104; stamp; st0604.timestamp.*; -
st0902.profile; ST 0902.8; metadata; st0902.*; NOT_APPLICABLE
st0903.lifecycle; ST 0903.6 7.2; state; ANY st0903.lifecycle.*; NOT_APPLICABLE
st0601.command.lifecycle; ST 0601.19 8.115; state; st0601.command.*; -
st1001.audio; ST 1001.1; pes; st1001.*; NOT_APPLICABLE
"""


def _table(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(";")] for line in text.split("\n") if line.strip()]


def findings(observed: DataFrame, scope: str, keys: Sequence[str], place: str, rules: str = RULES) -> DataFrame:
    """What the rules of a scope find in ``observed``: keys, ``place``, status, code, requirement. One pass; a null predicate finds nothing."""
    own = [r for r in _table(rules) if r[0] == scope]
    told = [F.when(F.expr(test), F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), F.lit(need or None).cast("string").alias("requirement"))) for _, status, code, need, test in own]
    return observed.select(*keys, place, F.explode(F.array_compact(F.array(*told))).alias("f")).select(*keys, place, "f.*")


def summary(found: DataFrame, evidence: DataFrame, keys: Sequence[str], rules: str = SUMMARY) -> DataFrame:
    """Decisions on each stream: keys, status, code, requirement.

    evidence: keys and a column of each scope, how many rows there were. A rule passes if there was something to look at and nothing
    blocks it; where there was nothing, its own status is told, or none. What a stream's findings come to is a set of codes, as small as
    the table of rules, so they are combined before they are shuffled.
    """
    codes = found.groupBy(*keys).agg(F.collect_set(F.when(F.col("status") == "ERROR", F.col("code"))).alias("__e"), F.collect_set("code").alias("__a"))
    none = F.array().cast("array<string>")
    at = evidence.join(codes, list(keys), "left").withColumns({"__e": F.coalesce("__e", none), "__a": F.coalesce("__a", none)})

    def decided(code: str, need: str, scope: str, block: str, otherwise: str):
        column, pattern = ("__a", block[4:]) if block.startswith("ANY ") else ("__e", block)
        stopped = F.exists(column, lambda c: c.startswith(pattern[:-1])) if pattern.endswith("*") else F.array_contains(column, pattern)
        there = F.coalesce(F.col(scope), F.lit(0)) > 0
        status = F.when(there & ~stopped, "PASS").when(~there, F.lit(None if otherwise == "-" else otherwise).cast("string"))
        return F.when(status.isNotNull(), F.struct(status.alias("status"), F.lit(code).alias("code"), F.lit(need or None).cast("string").alias("requirement")))

    return at.select(*keys, F.explode(F.array_compact(F.array(*[decided(*r) for r in _table(rules)]))).alias("s")).select(*keys, "s.*")
