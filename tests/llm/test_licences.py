from tessera.llm import licences as L

SCHEMA = "doc_id long, text string, row string, lines long, licences string"


def test_scan(spark):
    rows = [(k, f"Some text here.\n{t}\nmore text", "r", 1, "x") for k, t in enumerate(t for f in L.FAMILIES for t in L.TEMPLATES[f])]
    names = [f for f in L.FAMILIES for _ in L.TEMPLATES[f]]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "no cue at all", None, None, None), (103, "the software was released under a public bridge", None, None, None), (104, "\n".join(["All rights reserved.", "Released under the MIT License."] * 400) + "\n", None, None, None)]
    rows += [(104, "Released under the MIT License.", None, None, None), (None, "license.5 licence", None, None, None)]
    got = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (104, None)}
    right = sum(by[k].licences == name for k, name in enumerate(names))
    assert right >= 0.9 * len(names)
    assert all(by[k].licences == "" and by[k].n_confirmed == 0 for k in (100, 101, 102, 103))
    assert sorted((r.licences, r.n_confirmed) for r in got if r.doc_id == 104) == [("mit", 1), ("mit,reserved", 800)]
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_is_native(spark):
    plan = L.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def licences(spark, texts):
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.licences, r.n_unconfirmed) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_wrapped_notices_are_put_together(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = [f"Some program.\n\n{wrapped(t, w)}\n\nMore text." for t in (gpl, mit, bsd) for w in (30, 70)]
    assert [x for x, _ in licences(spark, texts)] == ["gpl", "gpl", "mit", "mit", "bsd", "bsd"]


def test_licences_of_no_family_are_unknown(spark):
    texts = ["This program is distributed under the Zlib license.", "Licensed under the Open Software License version 3.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: WTFPL", "Released under the Unlicensed Beer License.", "You may use it under the terms of the European Union Public Licence."]
    assert [x for x, _ in licences(spark, texts)] == [""] * len(texts)
    named = ["This program is distributed under the ISC license", "Licensed under the GNU Affero General Public License version 3", "Licensed under the GNU Lesser General Public License, version 2.1."]
    assert [x for x, _ in licences(spark, named)] == ["isc", "agpl", "lgpl"]
