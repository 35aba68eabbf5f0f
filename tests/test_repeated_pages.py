"""Pages that share an address, or whose addresses have one doc_id: every query has a row for each, as its SQL says."""

import __spark_entry__
import duckdb
import pytest

HTML = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>Of {0}.<p>{1}</article></body></html>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    # Three pages to an address, with other fragments at every second one; ids step through all residues.
    pages = [(k, f"https://h.test/en/{k % 70}{'#top' if k % 2 else ''}", HTML.format(f"Page {k}", "word " * (k % 9 * 60 + 1))) for k in range(210)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    return root


@pytest.mark.parametrize("name", ["page_chunks", "prepare_decisions", "sitemap_parse"])
def test_each_page_has_its_rows(spark, folder, name):
    made = __spark_entry__.queries()[name](spark, str(folder))
    names = ", ".join(f'"{c}"' for c in made.columns)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
        wanted = db.execute(f"SELECT {names} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, wanted))
