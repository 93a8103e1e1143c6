"""The registered queries of this subpackage and their SQL, added by ``__spark_entry__`` if it is present."""

from __future__ import annotations

from graphloom.llm import boilerplate, languages, lookalikes, mojibake, packing, similar, splitting, tokenizer
from graphloom.sources.tables import read_table


def queries() -> dict:
    return {
        "p1_found": lookalikes.found,
        "p1_normalized": lookalikes.normalized,
        "p1_classes": lookalikes.classes,
        "p2_found": splitting.found,
        "p2_pieces": splitting.catalog_pieces,
        "p3_found": similar.found,
        "p3_nearest": similar.nearest,
        "p4_found": boilerplate.found,
        "p4_body": boilerplate.main_body,
        "p6_found": mojibake.found,
        "p6_restored": mojibake.restored,
        "p7_ids": lambda spark, root: tokenizer.encode_corpus(read_table(spark, root, "documents")),
        "p8_pack": packing.pack_documents,
        "p8_fill": packing.container_fill,
        "p9_found": languages.found,
        "p9_segments": languages.segment_languages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT DISTINCT t.table_name, t.record_id
            FROM (SELECT 'functional_section' AS table_name, 'text' AS field_name, id AS record_id, text AS body FROM functional_section
                  UNION ALL SELECT 'rest_operation', 'description', id, description FROM rest_operation) t
            JOIN size_limits l ON l.table_name = t.table_name AND l.field_name = t.field_name AND l.unit = 'character'
            WHERE length(t.body) > l.max_size
        """,
    }
