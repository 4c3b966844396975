"""Licence scan: headers, wrapped notices, identifiers, licence files, edge rows."""

import pytest
from pyspark.sql import functions as F

from daybook.llm import license_texts as texts
from daybook.llm import licenses


def commented(text, mark="# ", width=60):
    """The text wrapped anew, each line behind a comment mark."""
    out = []
    for paragraph in text.split("\n\n"):
        line = ""
        for word in paragraph.split():
            if len(line) + len(word) > width:
                out.append(mark + line)
                line = ""
            line = (line + " " + word).strip()
        out += [mark + line, mark.rstrip()]
    return "\n".join(out)


GPL3 = texts.GNU_START.format(thing="program", kind="", choice="either", version="3", later=", or (at your option) any later version")
CASES = [
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0", 4),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;", "GPL-2.0", 4),
    ("# SPDX-License-Identifier: (ISC OR Foo-9)", "ISC", 4),
    ("# SPDX-License-Identifier: BSD-4-Clause", None, None),
    (commented(GPL3 + "\n\n" + texts.GNU_REST.format(thing="program", kind="")) + "\nimport os\n", "GPL-3.0", 3),
    (GPL3.replace("\n", " "), "GPL-3.0", 2),
    (commented(texts.APACHE, "// ") + "\nint main() {}", "Apache-2.0", 3),
    ("#!/bin/sh\n# Copyright 2020 A. Person\n#\n" + commented(texts.MOZILLA) + "\nls", "MPL-2.0", 3),
    (commented(texts.GNU_START.format(thing="library", kind="Lesser", choice="either", version="2.1", later=", or (at your option) any later version"), " * "), "LGPL-2.1", 3),
    ("Copyright (c) 2021, X Y\n\n" + "\n\n".join([texts.BSD_START, texts.BSD_TWO, texts.BSD_END]), "BSD-2-Clause", 2),
    (texts.BSD_START, "BSD-2-Clause", 2),
    ("Some words of prose stand here.\n\n" + texts.ISC + "\n\nand more of them there", "ISC", 2),
    ("see the terms and conditions of the public program, version 3 of the general work", None, None),
    ("a licensed driver drove on", None, None),
]


@pytest.fixture(scope="module")
def around(spark):
    """Documents beside the cases, from which the words get their weights."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("-doc_id - 1 AS doc_id", "concat('other/', doc_id) AS path", "text")


def test_headers_notices_and_identifiers(spark, around):
    rows = [(i, f"d{i}/f.c", text) for i, (text, *_) in enumerate(CASES)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").unionByName(around)
    got = {r["doc_id"]: (r["own_license"], r["own_level"]) for r in licenses.scan(files).where("doc_id >= 0").collect()}
    assert [(i, *got[i]) for i in range(len(CASES))] == [(i, name, level) for i, (_, name, level) in enumerate(CASES)]


def test_whole_licence_files(spark, around):
    bsd = [texts.BSD_START, texts.BSD_TWO, texts.BSD_NAMES, texts.BSD_END]
    rows = [
        (0, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + texts.MIT_GRANT + "\n\n" + texts.MIT_REST),
        (1, "b/COPYING", "Copyright (c) 2020, A. Person\n\n" + "\n\n".join(bsd)),
        (2, "c/LICENSE.txt", "Copyright (c) 2020, A. Person\n\n" + "\n\n".join(bsd[:2] + bsd[3:])),
        (3, "d/LICENCE", texts.ISC + "\n\n" + texts.ISC_END),
        (4, "b/x/y/z.c", "int x;"),
        (5, "e/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Preamble words\n\n" * 40),
        (6, "b/x/own.c", "// Licensed under the Apache License, Version 2.0.\n"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").unionByName(around)
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(files).where("doc_id >= 0").collect()}
    assert [got[i] for i in range(7)] == [
        ("MIT", None), ("BSD-3-Clause", None), ("BSD-2-Clause", None), ("ISC", None), ("BSD-3-Clause", "b"), ("GPL-3.0", None), ("Apache-2.0", None),
    ]


def test_keys_leave_nothing_out(spark, around):
    """With every template word as a key the result is the same."""
    picked = around.where("doc_id % 3 = 0").withColumn(
        "text", F.concat("text", F.lit("\n\nPermission to use this software for any purpose\n\nthe terms of the General Public License\n"))
    )
    want = licenses.scan(picked)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses, "key_words", lambda rows, _: sorted({r["word"] for r in rows}))
        every = licenses.scan(picked)
        assert sorted(map(str, want.collect())) == sorted(map(str, every.collect()))


def test_long_and_odd_texts(spark):
    long = "word " * 200_000 + "\nReleased under the MIT License.\n" + "# x\n" * 20_000
    rows = [(1, "p/a", long), (2, "p/b", "\f\v\r\n#\n//"), (3, "p/LICENSE", ""), (4, "p/c", "SPDX-License-Identifier:"), (4, "p/c", "SPDX-License-Identifier:")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert sorted((r["doc_id"], r["own_license"]) for r in got) == [(1, "MIT"), (2, None), (3, None), (4, None), (4, None)]
