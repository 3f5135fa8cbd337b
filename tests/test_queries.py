"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SMALL, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str(value) if hasattr(value, "isoformat") else value


def rows(found):
    return sorted((tuple(plain(v) for v in row) for row in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, SMALL)
    result = connection.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows(map(tuple, frame.select(*names).collect())) == rows(result.fetchall())


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_and_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_chatter_of_six_digit_keys_states_no_code(spark, tmp_path):
    """Keys from 100,000 on: their chatter was read as a message with a code of its own."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (o_orderkey + 100_000 as o_orderkey) from '{SMALL}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"copy (select * from '{SMALL}/customer.parquet') to '{tmp_path}/customer.parquet' (format parquet)")
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("message_fields", "message_flow_quarantine", "message_flow_totals"):
        frame, result = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert rows(map(tuple, frame.select(*names).collect())) == rows(result.fetchall()), name


def test_names_of_six_digit_keys_state_no_code(spark, tmp_path):
    """Companies from 100,000 on: their names were read as codes, so messages that only name one were assigned and parsed."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (o_custkey + 150_000 as o_custkey) from '{SMALL}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"copy (select * replace (c_custkey + 150_000 as c_custkey) from '{SMALL}/customer.parquet') to '{tmp_path}/customer.parquet' (format parquet)")
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("validation_counts", "message_flow_companies", "message_flow_disclosures", "message_flow_quarantine", "message_fields"):
        frame, result = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert rows(map(tuple, frame.select(*names).collect())) == rows(result.fetchall()), name


def test_lines_are_not_counted_by_owner(spark, tmp_path):
    """Orders with two owners are found without lines being joined and grouped, which took memory with all of them."""
    con = duckdb.connect()
    for t in TABLES:
        path = Path(SMALL, f"{t}.parquet")
        Path(tmp_path, path.name).symlink_to(path) if t != "orders" else None
    con.execute(f"copy (select * from '{SMALL}/orders.parquet' union all select * replace (o_custkey + 1 as o_custkey) from '{SMALL}/orders.parquet' where o_orderkey % 7 = 0) to '{tmp_path}/orders.parquet' (format parquet)")
    for t in TABLES:
        path = Path(tmp_path, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    frame, result = QUERIES["integrity_findings"](spark, str(tmp_path)), con.execute(ORACLES["integrity_findings"])
    names = [d[0] for d in result.description]
    wanted = rows(result.fetchall())
    assert rows(map(tuple, frame.select(*names).collect())) == wanted and any("several_owners" in r for r in wanted)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" not in plan


def equal_on_pages(spark, folder, pages, *names):
    """Queries give the rows of their SQL on pages (url, html)."""
    con = duckdb.connect()
    spark.createDataFrame([(k, *page) for k, page in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    for name in names:
        frame, result = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert rows(map(tuple, frame.select(*columns).collect())) == rows(result.fetchall()), name


#: Titles cut off in the middle of an entity, entities of other names, one that is written of another.
CUT_OFF = [("https://a.example.com/en/x", f"<title>The plant opens {end}</title><p>{end} rest</p>") for end in ("R&amp", "R&am", "a&lt;b&gt;", "x&amp;amp;y", "q&quot;", "q&quot", "&#39;s", "&copy", "&nbsp;b")]


def test_entities_that_are_cut_off_are_text(spark, tmp_path):
    """Pages with an entity without its semicolon, which was resolved all the same."""
    equal_on_pages(spark, tmp_path, CUT_OFF, "html_clean")


#: Titles with excluded terms as they are, in other cases, and with white space inside.
SPREAD = [(f"https://a.example.{end}/{lang}/x", f"<title>{title}</title>") for end in ("org", "com") for lang, title in (("en", "Up to therean"), ("en", "The o ther plant"), ("en", "OTHER plants"), ("en", "another the"), ("de", "der  die Bank"), ("de", "Der die Bank"), ("es", "dela casa"), ("es", "de la casa que"))]


def test_spread_terms_are_not_excluded(spark, tmp_path):
    """"to therean" was rejected for the term Other."""
    equal_on_pages(spark, tmp_path, SPREAD, "reject_counts")


def test_spread_terms_are_kept_in_the_ladder(spark, tmp_path):
    equal_on_pages(spark, tmp_path, SPREAD, "relevance_ladder")


def test_a_cut_off_entity_is_a_cluster_word(spark, tmp_path):
    """Two titles share "amp" and no more, so it links them."""
    cut_off = ("https://a.example.com/en/x", "<title>R&amp</title>")
    equal_on_pages(spark, tmp_path, [*CUT_OFF, cut_off, cut_off, ("https://a.example.com/en/x", "<title>S &amp</title>")], "similarity_clusters")


def test_titles_without_words_are_alike(spark, tmp_path):
    """Titles of stop words alone, or of nothing, within 72 hours: pages are an hour apart."""
    title = lambda k: "The And" if k % 2 else ""
    wordless = {0, 1, 30, 101, 174, 250, 322, 323, 395, 396, 420}
    pages = [("https://a.example.com/" + ("de" if k in (30, 420) else "en") + "/x", f"<title>{title(k) if k in wordless else f'page{k}'}</title>") for k in range(430)]
    equal_on_pages(spark, tmp_path, pages, "similarity_clusters")


def test_a_cut_off_entity_is_a_token(spark, tmp_path):
    equal_on_pages(spark, tmp_path, CUT_OFF, "title_tokens_jaccard")
