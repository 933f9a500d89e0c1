import duckdb

from graphloom.llm import license_scan as L

MIT = L.TEXTS["MIT"]
TEXTS = [
    None, "", "Plain prose.", "Released under the MIT License.", "first line\nLICENCED under the Apache Licence, version 2.0\nlast", MIT, f"MIT License\n\nCopyright (c) 1999 Some One\n\n{MIT.upper()}",
    f"# {MIT}".replace("\n\n", "\n#\n# ").replace(", ", ",\n# "), f"Prose before.\n\n{L.TEXTS['GPL-3.0'].split(chr(10))[0]}\n\nSPDX-License-Identifier: GPL-3.0\n", "Released under the MIT License.\n" * 3, "this work is licensed under CC BY-NC 4.0!", "x " * 30_000, "Released under the MIT License.",
    "prose\nLicensed_under the MIT License\nprose", "* Copyright 2001 A. Body\n" + L.TEXTS["BSD-2-Clause"].replace(", ", ",\n * "), "zlib License\n\n" + L.TEXTS["Zlib"],
]


def test_findings(spark):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, license string, digest string")
    got = {r.doc_id: (r.license, r.licenses, r.n_matches) for r in L.license_scan(df).collect()}
    assert got == {
        0: ("", "", 0), 1: ("", "", 0), 2: ("", "", 0), 3: ("MIT", "MIT", 1), 4: ("", "Apache-2.0", 1), 5: ("MIT", "MIT", 1), 6: ("MIT", "MIT", 1), 7: ("MIT", "MIT", 1), 8: ("", "GPL-3.0", 1), 9: ("", "MIT", 1),
        10: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), 11: ("", "", 0), 12: ("MIT", "MIT", 1),
        13: ("", "MIT", 1), 14: ("BSD-2-Clause", "BSD-2-Clause", 1), 15: ("Zlib", "Zlib", 1),
    }


def test_against_sql(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = sorted(map(tuple, L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "canonical_sha256", "license", "licenses", "n_matches").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert got == sorted(con.execute(L.oracle()).fetchall())


def test_null_and_repeated_ids(spark):
    rows = [(None, "Released under the MIT License.\nprose"), (None, "prose"), (1, "prose"), (1, "prose\nSPDX-License-Identifier: ISC"), (1, "prose")]
    got = sorted((str(r.doc_id), r.licenses) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", ""), ("1", ""), ("1", "ISC"), ("None", ""), ("None", "MIT")]


def test_empty_table(spark):
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
