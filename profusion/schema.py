"""Data model: one row per source record, one row per entity."""

from __future__ import annotations

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:int>"
#: ``value`` is JSON text: a string, number, object, list or null.
PROVENANCE = "struct<field:string,source_id:string,source_type:string,method:string,value:string,confidence:double,note:string>"
SKILL = "struct<name:string,confidence:double,sources:array<string>>"

RAW = (
    f"rec_pos long, source_id string, source_type string, method string, full_name string, emails array<string>, phones array<string>, location {LOCATION}, "
    f"links {LINKS}, headline string, years_experience double, skills array<string>, experience array<{EXPERIENCE}>, education array<{EDUCATION}>"
)
CANONICAL = (
    f"candidate_id string, full_name string, emails array<string>, phones array<string>, location {LOCATION}, links {LINKS}, headline string, years_experience double, "
    f"skills array<{SKILL}>, experience array<{EXPERIENCE}>, education array<{EDUCATION}>, provenance array<{PROVENANCE}>, possible_duplicate_of array<string>, overall_confidence double"
)
RAW_FIELDS = [x.strip().split(" ")[0] for x in "rec_pos source_id source_type method full_name emails phones location links headline years_experience skills experience education".split()]
