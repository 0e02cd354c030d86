"""The queries of the eight problems and, where SQL can state them on whole tables, their SQL."""

from __future__ import annotations

from . import containers, defects, encoding, labels, lookalikes, overlaps, pieces, terms

QUERIES = {
    f.__name__: f
    for f in (
        labels.p1_found, labels.p1_unmatched,
        terms.p2_found, terms.p2_counts,
        defects.p3_found, defects.p3_by_model,
        pieces.p4_found, pieces.p4_pieces,
        overlaps.p5_found, overlaps.p5_report, overlaps.p5_classes,
        encoding.p6_ids,
        containers.p7_containers, containers.p7_fill,
        lookalikes.p8_found, lookalikes.p8_forms, lookalikes.p8_classes,
    )
}

_VALUES = "with v as (select 'source_example.relation' as field, relation as x from source_example union all select 'generation.generated_relation', generated_relation from generation), r as (select field, row_number() over () as rid, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') as ts from v where x is not null), o as (select field, rid, unnest(ts) as term from r), c as (select field, term, count(*) as occurrences, count(distinct rid) as records from o group by field, term), m as (select *, case when records <= 2 then 'rare' when occurrences * 100 >= sum(occurrences) over (partition by field) then 'common' end as mark from c) "
SQL = {
    "p2_found": _VALUES + "select field, term, mark from m where mark is not null",
    "p2_counts": _VALUES + "select field, term, occurrences, records, mark from m",
    "p4_found": "select example_id, 'text' as field from source_example where length(text) > 1600 union all select example_id, 'prompt_2_shot' from source_example where length(prompt_2_shot) > 1600",
}
