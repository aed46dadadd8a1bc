"""Fill-in-the-middle beside a plain version and SQL, on awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import awkward, frame  # noqa: F401
from tools.check import compare, connect
from vigilgrid.llm import middle
from vigilgrid.llm.queries import op11_fill_in_middle


def plain(ident, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(name[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows(awkward):  # noqa: F811
    odd = ["a<P>b", "<S", "<", "<P", "x<M>", "\x00\xff a\n\r\nb", "ÿþ é", "🙂" * 50, "a" * 70000, "<" * 40, "<S<P<M" * 9]
    return awkward + awkward[-3:] + [(100 + i, odd[i % len(odd)]) for i in range(220)]


def test_equals_plain_version_and_restores(spark, rows):
    out = middle.transformed(frame(spark, rows))
    got = out.withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted(str((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(
        str((i, *plain(i, t))) for i, t in rows)
    assert sorted((str(r.row.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got} and got[0].row.asDict().keys() == set(frame(spark, []).columns)


def test_matches_sql(spark, rows, tmp_path):
    con, path = connect(SF), str(tmp_path / "documents.parquet")
    frame(spark, [r for r in rows if "\x00" not in (r[1] or "")]).write.parquet(path)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert compare(op11_fill_in_middle(spark, str(tmp_path)), con, middle.sql("documents"))[0] == "ok"


def test_no_rows(spark):
    assert middle.transformed(frame(spark, [])).count() == 0
