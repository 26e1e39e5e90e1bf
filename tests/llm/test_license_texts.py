"""Whole licence texts, wrapped headers and SPDX names."""

from linkspark.llm import licenses
from linkspark.llm.license_texts import WHOLE

GPL = """Copyright (C) 2019 Jane Doe
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_headers_names_and_whole_texts(spark):
    whole = dict(WHOLE)
    without_appendix = whole["GPL-3.0"][: whole["GPL-3.0"].index("How to Apply These Terms")]
    terms = whole["Apache-2.0"][: whole["Apache-2.0"].index("END OF TERMS")]
    rows = [(GPL, "GPL-3.0"), (GPL.replace("version 3", "version 2"), "GPL-2.0"), (without_appendix, "GPL-3.0"), (terms, "Apache-2.0")]
    rows += [("some code\n// SPDX-License-Identifier: " + name + "\n", want) for name, want in (("GPL-2.0-only", "GPL-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("ISC", "ISC"), ("MIT", "MIT"))]
    rows += [(f"Copyright 2020 Someone\n\n{t}", name) for name, t in WHOLE]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert got == {i: name for i, (_, name) in enumerate(rows)}
