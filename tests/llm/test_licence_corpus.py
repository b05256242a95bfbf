"""Licence scan: what is counted over the whole corpus, and what a paragraph is."""

from panelcast.llm import license_scan

NOTICE = "Released under the MIT License."


def name(k):
    return "x" + "".join(chr(97 + int(c)) for c in str(k))


def corpus(spark, extra, n=1500):
    rows = [(i, f"{name(i % 997)} {name(i)} {name(i % 83)}\nline {name(i % 73)}") for i in range(n)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string")


def test_everyday_words_are_counted_in_every_line(spark):
    heavy = "\n".join(f"{name(k)} software {name(k + 7)} released {name(k + 9)}" for k in range(60))
    # one document's words are no everyday words of 5,000 lines, but would be of a sample that holds it
    docs = corpus(spark, [(9000, heavy), (9001, NOTICE)], 5000)
    assert not license_scan.everyday_words(docs, "doc_id", "text")
    # words of notices are not everyday words because notices are common; other lines' words are
    many = corpus(spark, [(9000 + k, f"{NOTICE}\nthe version {name(k)} iota") for k in range(400)])
    assert license_scan.everyday_words(many, "doc_id", "text") == {"the", "version"}


def test_lines_on_licences_are_unknown_and_the_sample_is_a_parameter(spark):
    docs = corpus(spark, [(9000, "The licensed driver kept a licence plate.\n" + NOTICE)], 20)
    rows = [r for r in license_scan.training_rows(docs, "doc_id", "text", 6, unknown_docs=50).where("corpus").collect()]
    grams = [set(r.grams) for r in rows]
    assert any("licence plate" in g for g in grams) and not any("mit license" in g for g in grams)
    few = license_scan.training_rows(corpus(spark, []), "doc_id", "text", 6, unknown_docs=50).where("corpus").count()
    assert 0 < few < 300


MIT = """Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction"""
GPL2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; version 2 of the License."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""
VERSIONLESS = "This code is licensed under the GNU General Public License."


def test_wrapped_and_versionless_notices_are_one_row(spark):
    texts = {9000: MIT, 9001: "intro\n\n" + GPL2 + "\n\noutro", 9002: APACHE, 9003: VERSIONLESS, 9004: "one\n" + MIT + "\n\n" + NOTICE,
             9005: f"a line\n{NOTICE}\nThe driving licence is new.\nLicensed under CC BY 4.0.\nlast", 9006: "a\n \t\r\n" + NOTICE + "\r\n"}
    got = license_scan.scan(corpus(spark, list(texts.items()), 300)).where("confirmed").collect()
    rows = sorted((r.doc_id, r.paragraph, r.family) for r in got if r.doc_id != 9003)
    assert rows == [(9000, 0, "MIT"), (9001, 2, "GPL-2.0"), (9002, 0, "Apache-2.0"), (9004, 0, "MIT"), (9004, 5, "MIT"),
                    (9005, 1, "MIT"), (9005, 3, "CC-BY-4.0"), (9006, 2, "MIT")]
    assert {r.text for r in got if r.doc_id == 9000} == {MIT.replace("\n", " ")}
    bare = [r.family for r in got if r.doc_id == 9003]
    assert len(bare) == 1 and bare[0] in ("GPL-2.0", "GPL-3.0")


def test_a_table_of_null_ids_is_scanned(spark):
    rows = [(None, f"{name(i)} {name(i % 83)}\nline {name(i % 73)}") for i in range(200)] + [(None, "intro\n" + NOTICE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(docs).where("confirmed").collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in got] == [(None, 1, "MIT")]
    # the rows of a null id are picked one by one
    picked = license_scan.training_rows(docs, "doc_id", "text", 6, unknown_docs=50).where("corpus").count()
    assert 0 < picked < 300
