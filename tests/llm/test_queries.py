"""The registered queries: their columns, and those that SQL can express against their SQL twins."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from check import duck, normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text_sha256 string",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_shard_tree": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_sketches": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_partenum": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string",
    "pipeline": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(queries()[name](spark, FOLDER).dtypes)
    for column in COLUMNS[name].split(", "):
        assert kinds[column.split()[0]] == column.split()[1], column


@pytest.mark.parametrize("name", sorted(set(COLUMNS) & set(oracle_sql())))
def test_query_equals_sql(spark, name):
    mine = queries()[name](spark, FOLDER).toPandas()
    theirs = duck(FOLDER).execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns) and len(mine) > 0
    assert normal(mine) == normal(theirs)
