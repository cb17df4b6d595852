from flowloom.llm.licences import KNOWN, ONE_OF, known, scan


def test_scan(documents, spark):
    mit = KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "licence")), (2, None), (3, ""), (4, " !!\n"), (5, mit + " extra"),
            (6, "All rights reserved.\n" + KNOWN["BSD-3-Clause"].replace("\n", "\r\n")), (None, "“" + KNOWN["ISC"].replace(" ", "\n  ") + "”"), (1, mit), (7, mit * 500)]
    got = scan(documents(rows), known(spark)).collect()
    assert sorted((r.doc_id or 0, r.license_id or "") for r in got) == sorted(
        [(1, "MIT"), (2, ""), (3, ""), (4, ""), (5, ""), (6, "BSD-3-Clause"), (0, "ISC"), (1, "MIT"), (7, "")])
    assert all((r.digest is None) == (r.doc_id in (2, 3, 4)) for r in got)
    assert scan(documents([]), known(spark)).collect() == []


def test_known_texts_differ(spark):
    assert known(spark).select("license_digest").distinct().count() == len(KNOWN)


def test_licence_files(documents, spark):
    """Files as projects have them: titles, copyright lines of any form, list marks, comment stars."""
    mit, bsd = KNOWN["MIT"], KNOWN["BSD-3-Clause"]
    stars = lambda t: "/*\n" + "".join(f" * {line}\n" for line in t.split("\n")) + " */"
    gpl, apache = KNOWN["GPL-3.0"], KNOWN["Apache-2.0"]
    rows = [("MIT License\n\nCopyright (c) 2021 A. Person\n\n" + mit, "MIT"), ("The MIT License (MIT)\r\n\r\nCopyright Google LLC\r\n\r\n" + mit.replace("\n", "\r\n"), "MIT"),
            ("Copyright The Authors\nCopyright 2019-2020, Others\n(c) 2021 More\n" + mit, "MIT"), ("BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"),
            (bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"), (stars("ISC License\n\n" + KNOWN["ISC"]), "ISC"),
            ("zlib License\n\n" + KNOWN["Zlib"].replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) "), "Zlib"), (gpl, "GPL-3.0"), (stars(gpl), "GPL-3.0"), (apache, "Apache-2.0"),
            (apache[:apache.index("END OF TERMS")], "Apache-2.0"), (KNOWN["LGPL-2.1"], "LGPL-2.1"), (KNOWN["MPL-2.0"], "MPL-2.0"), (KNOWN["CC-BY-SA-4.0"], "CC-BY-SA-4.0"),
            ("Some prose on the MIT License.\n" + mit, None), (gpl[:3000], None), ("Licensed under the Apache License, Version 2.0.", None), ("MIT License", None), ("MIT License\n", None)]
    got = scan(documents([(i, t) for i, (t, _) in enumerate(rows)]), known(spark)).collect()
    assert {r.doc_id: r.license_id for r in got} == {i: k for i, (_, k) in enumerate(rows)}
    assert all(any(x in t.lower() for x in ONE_OF) for t in KNOWN.values())
    few = scan(documents([(i, t) for i, (t, _) in enumerate(rows)]), known(spark), ONE_OF).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))
    junk = scan(documents([(1, "\n" * 200_000 + "é-" * 100_000 + "MIT License\n"), (2, "the " * 100_000)]), known(spark)).collect()
    assert all(r.license_id is None for r in junk)


def test_words_of_sentences_stay(spark):
    """A wrapped sentence may begin a line with 'copyright'; it is not dropped."""
    from pyspark.sql import functions as F
    from flowloom.llm.licences import stripped
    a, b = "by the\ncopyright holders and others\n(c) you must\ncopyright notice", "by the copyright holders and others (c) you must copyright notice"
    got = spark.createDataFrame([(a,), (b.replace("(c) ", ""),)], "text string").select(F.expr(stripped("text"))).collect()
    assert got[0] == got[1]
