from pathlib import Path

import pytest

from lodestitch.llm import licences

FILES = "file bigint, path string, text string, licence string, dir string"


def scan(spark, *rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], FILES)
    return {r.file: (r.licence, r.how, r.origin) for r in licences.scan_licences(df).collect()}


def test_headers_and_inheritance(spark):
    got = scan(
        spark,
        (1, "r/LICENSE", "Released under the MIT License."),
        (2, "r/a/b/code.py", "nothing here"),
        (3, "r/a/LICENSE.txt", "x\nThis work is licensed under the GNU General Public License, version 3.\n"),
        (4, "r/a/own.py", "# Licensed under CC BY-NC 4.0.\ncode"),
        (5, "q/none.py", None),
        (6, None, "Released under the MIT License"),
        (7, None, ""),
        (8, "top.py", "license to nothing in particular at all, whatever it may be"),
        (9, "r/ab/code.py", "word " * 50_000),
        (10, "r/a/b/code.py", "again the same path"),
    )
    assert got[1] == ("MIT", "header", "r/") and got[3] == ("GPL-3.0", "header", "r/a/")
    assert got[2] == ("GPL-3.0", "inherited", "r/a/") == got[10]
    assert got[4][:2] == ("CC-BY-NC-4.0", "header")
    assert got[5] == (None, "none", None) == got[7] == got[8]
    assert got[6][:2] == ("MIT", "header") and got[9] == ("MIT", "inherited", "r/")


def test_best_licence_file_of_a_directory(spark):
    got = scan(spark, (1, "d/LICENSE", "Released under the MIT License, more or less, they said"), (2, "d/COPYING", "Licensed under CC BY-NC 4.0."), (3, "d/x", ""))
    assert got[3] == ("CC-BY-NC-4.0", "inherited", "d/")


def _wrapped(text, width, sign):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(sign + line.strip())
            line = ""
        line += " " + word
    return "\n".join([*lines, sign + line.strip()])


def test_wrapped_headers_and_whole_texts(spark):
    t = licences.TEMPLATES
    got = scan(
        spark,
        (1, "a/x.py", "#!/bin/sh\n\n" + _wrapped("Copyright 2020 A. B. " + t["Apache-2.0 (header)"], 60, "# ") + "\n\nimport os\n" * 3),
        (2, "b/y.c", "/*\n" + _wrapped(t["GPL-3.0 (header)"], 40, " * ") + "\n */\nint main() { return 0; }"),
        (3, "c/LICENSE", "MIT License\n\nCopyright (c) 2021 Somebody Else\n\n" + _wrapped(t["MIT (text)"], 70, "")),
        (4, "d/COPYING", "Copyright (c) 1999, The Others\n" + _wrapped(t["BSD-3-Clause (text)"], 70, "")),
        (5, "e/z.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"),
        (6, "f/w.js", "// SPDX-License-Identifier: Apache-2.0"),
        (7, "g/v.py", "# a comment\n# about nothing\n# at all, in several lines\nx = 1"),
        (8, "d/below/u.py", "x = 1"),
    )
    assert {k: v[0] for k, v in got.items()} == {1: "Apache-2.0", 2: "GPL-3.0", 3: "MIT", 4: "BSD-3-Clause", 5: "MIT", 6: "Apache-2.0", 7: None, 8: "BSD-3-Clause"}


def test_published_texts(spark):
    folder = Path("/usr/share/common-licenses")
    if not (folder / "Apache-2.0").exists():
        pytest.skip("no published texts here")
    got = scan(spark, (1, "a/LICENSE", (folder / "Apache-2.0").read_text()), (2, "b/LICENSE.txt", (folder / "BSD").read_text()))
    assert (got[1][0], got[2][0]) == ("Apache-2.0", "BSD-3-Clause")


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    t = licences.TEMPLATES
    texts = ["word " * 40, None, "", "Released under the MIT License.\nmore", "# one\n# two\nthree", _wrapped(t["MIT (text)"], 60, "// "), _wrapped(t["MIT (text)"], 60, ""), "All rights reserved.", "\n\n#a\n\n#b", "the the the license"] * 3
    spark.createDataFrame([(n, x, "s") for n, x in enumerate(texts)], "doc_id bigint, text string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = licences.op3_licences(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({licences.OP3_SQL})").fetchall(), key=str)


def test_empty(spark):
    assert scan(spark) == {}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (licences._GNU_2.format(this="This program", that="this program", kind="", version="2"), "GPL-2.0"),
        (licences._GNU_2.format(this="My library", that="my library", kind="Lesser ", version="2.1"), "LGPL-2.1"),
        (licences._GNU.format(this="This program", kind=""), "GPL-3.0"),
        (licences._GNU.format(this="This file", kind="Lesser "), "LGPL-3.0"),
        (licences._GNU.format(this="This program", kind="Affero "), "AGPL-3.0"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("Apache License, Version 1.1", "Apache-1.1"),
        ("Apache License, Version 2.0", "Apache-2.0"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the Apache License, Version 4.5.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 7.", None),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC 3.0.", None),
    ],
)
def test_versions_are_told_apart(text, want):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    found = licences.Scorer().best(data, np.array([0, data.size]), np.array([False]))[0]
    assert (found and found[0].split(" ")[0]) == want


def test_long_texts_and_repeated_rows(spark):
    long = "word " * 300_000 + "\n# Licensed under CC BY-NC 4.0.\n" + "x " * 300_000
    got = licences.scan_licences(spark.createDataFrame([(n, "a/b.txt", long, "x", "y") for n in (1, 2)], FILES)).collect()
    assert [(r.licence, r.how) for r in got] == [("CC-BY-NC-4.0", "header")] * 2
