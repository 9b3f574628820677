import re

from pathloom.llm import licenses as lic

WORD = re.compile(lic.LICENSE_WORD)


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, base = [], set()
    for phrase, label in lic.PHRASES.items():
        parts = phrase.split(" ")
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 0.0
    lines = [set(WORD.findall(line)) for line in lower.split("\n")]
    for label, wording, *must in lic.TEMPLATES:
        must = set(" ".join(must).split())
        step, want = 1, set(wording.split(" "))
        while step < len(wording.split(" ")) / 0.8 - 1e-9:
            step *= 2
        windows = [set(words[a : a + 2 * step]) for a in range(0, len(words), step)]
        for have in lines + windows:
            if len(have & want) >= 0.8 * len(want) - 1e-9 and must <= have:
                labels.add(label)
                score = max(score, len(have & want) / len(want))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def check(df):
    rows = df.collect()
    got = sorted((tuple(r) for r in lic.license_scan(df).collect()), key=str)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in rows), key=str)
    return got


def test_wordings_near_the_threshold(spark):
    texts = [
        "Released under the MIT License.", "MIT\nLicense", "mit license mit license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed### under&&& CC%%% BY-NC*** 4.0", "GNU General Public License", "mit liKense", "the the the", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and files",
        "İ mit license ÉMIT LICENSE", "this program is free software\nyou can redistribute it", "all rights reserved", "under the mit license", "released under mit license",
    ]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert any("mit" in r[6] and not r[5] for r in got) or any(r[6] != r[5] for r in got)


def test_odd_documents(odd_docs, no_docs):
    check(odd_docs)
    assert lic.license_scan(no_docs).count() == 0


def test_sql_is_the_same(spark, sf_dir):
    import duckdb

    from pathloom.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in queries.SQL.items():
        spark_rows = queries.QUERIES[name](spark, sf_dir)
        columns = sorted(spark_rows.columns)
        want = con.sql(sql).project(", ".join(columns)).fetchall()
        assert sorted(map(tuple, spark_rows.select(*columns).collect()), key=str) == sorted(want, key=str), name


def test_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files"
    isc = " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted"
    lgpl = (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation"
    )
    scattered = "\n".join(f"{w} one two three four five six seven" for w in bsd.split())
    whole = next(w for label, w, *_ in lic.TEMPLATES if label == "mit" and len(w) > 300).split(" ")
    long = "\n".join(" ".join(whole[i : i + 9]) for i in range(6, len(whole), 9))
    texts = [bsd, mit, isc, lgpl, scattered, "x y z\n" * 300 + bsd + "\nx y z" * 300, "a b\n" * 7 + long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lic.license_scan(df).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["bsd", "mit", "isc", "lgpl", "", "bsd", "mit"]
    check(df)
    assert got[0]["score"] == 1.0 and got[4]["score"] == 0.0


def test_notices_worded_alike_are_told_apart(spark):
    texts = {
        "Released under the Apache License": "apache", "Licensed under the Mozilla Public License, version 2.0": "", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "agpl,gpl",
        "Licensed under the Apache License, Version 2.0": "apache",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    got = {r["doc_id"]: r["labels"] for r in lic.license_scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
