import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.llm import licenses
from missive.llm.topk import search
from missive.operators import retrieve


def test_topk_equals_brute_force_with_ties(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(150)]
    vectors += [(150 + i, vectors[7][1]) for i in range(30)] + [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [float("inf")]), (400, []), (450, [0.5])]
    got = search(spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string").repartition(5), F.col("vec_id") % 50 == 0, 5, block=2)
    usable = {i: np.floor(256 * np.array((v + [0.0] * 6)[:6])).astype(int) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


def test_topk_with_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert search(few.limit(0), F.lit(True), 5).count() == 0


def test_licences(spark, odd_docs, no_docs):
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [
        (1, "Copyright (c) 2020 A. Author\n\n" + mit.replace(", ", ",\n  ").replace("sublicense", "sublicence")), (2, "text\nLicensed under the Apache Licence, Version 2.0."),
        (3, "Released under the MIT License.\nx\nThis work is licensed under the GNU General Public License v3"), (4, mit + " and more"), (5, "no licence here"), (6, None), (7, "CC BY-NC 4.0"), (8, "Licensed under Creative Commons Attribution-NonCommercial 4.0 International License"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line"], r["license_id"]) for r in licenses.scan(docs.withColumn("digest", F.lit(1))).collect()}
    assert got == {(1, 0, "MIT"), (2, 2, "Apache-2.0"), (3, 1, "MIT"), (3, 3, "GPL-3.0"), (8, 0, "CC-BY-NC-4.0")}
    con = duckdb.connect()
    frame = docs.toPandas()  # noqa: F841  read by name
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    assert {tuple(r)[:3] for r in con.execute(licenses.sql()).fetchall()} == got
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(odd_docs).count() == 0


def test_notices_without_the_word_licence(spark):
    notices = {"Released under the GPLv3.": "GPL-3.0", "Distributed under the GNU GPL v2.0": "GPL-2.0", "This work is made available under CC BY-SA 4.0": "CC-BY-SA-4.0", "Provided under CC0 1.0": "CC0-1.0", "Released under Creative Commons Attribution 4.0 International": "CC-BY-4.0"}
    rows = [(i, text) for i, text in enumerate(notices)] + [(9, "code\n" + "\n".join(notices) + "\nunder the bridge")]
    got = {(r["doc_id"], r["line"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0, v) for i, v in enumerate(notices.values())} | {(9, i + 2, v) for i, v in enumerate(notices.values())}


def test_whole_texts_with_titles_marks_and_copyright_lines(spark):
    texts = dict(licenses.TEXTS + licenses.MORE_TEXTS)
    mit, bsd = texts["MIT"], texts["BSD-3-Clause"].replace("the above copyright notice", "the above\ncopyright notice")
    marked = "".join(f"// {line}\n" for line in ["The MIT License (MIT)", "", "Copyright (c) 2020 X. All rights reserved.", "", *mit.split(". ")])
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 X\n\n" + mit), (2, marked), (3, "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd), (4, "/*\n * ISC License\n *\n * Copyright 2020 X\n *\n * " + texts["ISC"] + "\n */"),
        (5, texts["Unlicense"]), (6, "MIT License"), (7, "A song\n" + mit), (8, "MIT License\n\n" + mit + " and more"),
    ]
    got = {(r["doc_id"], r["line"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("line = 0").collect()}
    assert got == {(1, 0, "MIT"), (2, 0, "MIT"), (3, 0, "BSD-3-Clause"), (4, 0, "ISC"), (5, 0, "Unlicense")}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="needs the published texts")
def test_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"/usr/share/common-licenses/{n}").read() for n in names]
    rows = list(enumerate(texts)) + [(10 + i, "".join(f"# {line}\n" for line in t.split("\n"))) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("line = 0").collect()}
    assert got == {k + i: v for k in (0, 10) for i, v in enumerate(names.values())}


def test_dense_candidates_of_more_queries_than_a_block(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "doc_id long, e array<double>").select("doc_id", retrieve.quantised(F.col("e")).alias("v"))
    queries = vectors.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    whole, parts = (sorted(tuple(x) for x in retrieve.dense_candidates(queries, vectors, depth=7, dims=4, block=b).collect()) for b in (15, 4))
    assert len(whole) == 15 * 7 and parts == whole


@pytest.mark.parametrize(
    "license_id,notices",
    [
        ("MIT", ["Licensed under MIT", "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: MIT", "Released under the MIT licence."]),
        ("Apache-2.0", ["Licensed under Apache-2.0", "Licensed under the Apache 2.0 license", "# SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0"]),
        ("BSD-3-Clause", ["Licensed under the BSD 3-Clause", "Licensed under the 3-Clause BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the three-clause BSD licence"]),
        ("BSD-2-Clause", ["Licensed under the Two-Clause BSD License", "SPDX-License-Identifier: BSD-2-Clause"]),
        ("GPL-3.0", ["Licensed under the GNU GPL version 3 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GPLv3"]),
        ("LGPL-2.1", ["SPDX-License-Identifier: LGPL-2.1-or-later"]), ("MPL-2.0", ["SPDX-License-Identifier: MPL-2.0"]), ("EPL-2.0", ["Licensed under EPL-2.0"]), ("CC-BY-SA-4.0", ["SPDX-License-Identifier: CC-BY-SA-4.0"]),
        (None, ["Licensed under MIT and more", "SPDX-License-Identifier: MIT OR Apache-2.0", "Licensed under a mitten", "Licensed under Apache", "an MIT course under way"]),
    ],
)
def test_equivalent_spellings_of_notices(spark, license_id, notices):
    rows = [(i, n) for i, n in enumerate(notices)] + [(100 + i, f"first line\n{n}\nlast") for i, n in enumerate(notices)]
    got = {(r["doc_id"], r["line"]): r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {} if license_id is None else {(i, 0): license_id for i in range(len(notices))} | {(100 + i, 2): license_id for i in range(len(notices))}
    assert got == want
