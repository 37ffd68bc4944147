import os
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skyweave.llm import licenses


def test_whole_texts_and_lines(spark):
    mit = licenses.TEXTS["MIT"]
    docs = spark.createDataFrame(
        [
            (1, mit, "x"),
            (2, "Copyright (c) 1999 Someone\n" + mit.upper().replace(",", " , ") + "\n\nAll rights reserved.", "x"),
            (3, mit + " And more.", "x"),
            (4, None, "x"),
            (5, "", "x"),
            (6, "words\nReleased under the MIT Licence!\n  released UNDER the mit license\nmore", "x"),
            (6, "words\nReleased under the MIT Licence!\n  released UNDER the mit license\nmore", "x"),
            (None, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0.", "x"),
        ],
        "doc_id long, text string, license_id string",
    )
    rows = licenses.scan(docs).collect()
    assert len(rows) == 8
    by = {r["doc_id"]: (r["license_id"], r["n_notices"], r["notices"]) for r in rows}
    assert by == {1: ("MIT", 0, ""), 2: ("MIT", 0, ""), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 0, ""), 6: (None, 2, "MIT"), None: (None, 1, "CC-BY-NC-4.0")}
    assert sum(r["doc_id"] == 6 for r in rows) == 2
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_width_and_title(spark):
    """However a text is wrapped, titled and indented, it is the same."""
    rows = []
    for i, t in licenses.TEXTS.items():
        for width in range(40, 131, 3):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))
            for title in ["", *licenses.TITLES[i]]:
                rows.append((i, f"{title}\n\nCopyright (c) 2011, 2014 Some One <some@one.org>\n\n{textwrap.indent(wrapped, ' * ')}"))
    docs = spark.createDataFrame([(k, t, i) for k, (i, t) in enumerate(rows)], "doc_id long, text string, expected string")
    found = licenses.scan(docs).join(docs, "doc_id").where("license_id is null or license_id <> expected")
    assert found.count() == 0


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no license texts on this machine")
def test_long_licenses(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows = []
    for i, f in files.items():
        text = Path(COMMON, f).read_text("utf-8", "replace")
        rows += [(i, text), (i, text.upper()), (i, textwrap.indent(text, "// ")), (None, text + "\nand more"), (None, text[: len(text) // 2])]
    docs = spark.createDataFrame([(k, t, i) for k, (i, t) in enumerate(rows)], "doc_id long, text string, expected string")
    assert licenses.scan(docs).join(docs, "doc_id").where("not license_id <=> expected").count() == 0


def test_whole_words_and_own_tables(spark):
    """Spellings are words, not parts of words; a table of one's own may have
    notices of any words, and an id that two texts share goes to the first."""
    docs = spark.createDataFrame([(1, "whilst whilst the licence"), (2, "while while the license"), (3, "the httpd"), (4, "the httpsd"), (5, "words\nfree for all\nmore")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["digest"] == got[2]["digest"] and got[3]["digest"] != got[4]["digest"] and got[5]["n_notices"] == 0
    own = spark.createDataFrame([("X", "free for all")], "license_id string, text string").select("license_id", F.sha2(licenses.canonical(F.col("text")), 256).alias("digest"), F.lit(False).alias("whole"))
    assert {r["doc_id"]: r["notices"] for r in licenses.scan(docs, own).collect()}[5] == "X"
    both = licenses.known(spark).groupBy("digest", "whole").count()
    assert both.where("count > 1").count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(none).count() == 0 and "license_id" in licenses.scan(none).columns
