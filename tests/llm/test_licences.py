from __future__ import annotations

import pytest

from scorekit.llm import licences
from tests.llm.helpers import docs_of, odd_rows, rows_of

MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
BSD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]),
        (APACHE, ["Apache-2.0"]),
        (BSD, ["BSD-2-Clause"]),
        (BSD + "\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or "
         "promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        (GPL, ["GPL-3.0-or-later"]),
        ("text\nReleased under the MIT License.\nmore. Licensed under CC BY-NC 4.0. End", ["MIT", "CC-BY-NC-4.0"]),
        ("THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", ["GPL-3.0-only"]),
        ("a licence to kill. The copy was made under the MIT License here.", []),
    ],
)
def test_texts(spark, text, want):
    (r,) = rows_of(licences.scan(docs_of(spark, [(1, text, "en", "s")])))
    assert r["licences"] == want


def test_a_rule_uses_its_identifiers_up(spark):
    (r,) = rows_of(licences.scan(docs_of(spark, [(1, MIT + "\nMIT License\n\nSee the GNU General Public License for more details.", "en", "s")])))
    assert r["licences"] == ["MIT"] and "gpl.details" in r["unmatched"] and "mit.title" not in r["unmatched"]


def test_odd_rows(spark):
    got = rows_of(licences.scan(docs_of(spark, odd_rows())))
    assert len(got) == len(odd_rows()) and all(r["licences"] == r["sentences"] == [] for r in got)
    assert rows_of(licences.scan(docs_of(spark, []))) == []


def test_no_python_in_the_plan(spark):
    plan = licences.scan(docs_of(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MPL, ["MPL-2.0"]),
        (MPL.replace("// ", ""), ["MPL-2.0"]),
        (MPL.replace("v. 2.0", "v.\n// 2.0"), ["MPL-2.0"]),
        (MPL.replace("// ", "").replace("Public\n", "Public "), ["MPL-2.0"]),
        (MPL.replace("v. 2.0", "v. 3.0"), []),
        ("See v. Licensed under CC BY 4.0. End", ["CC-BY-4.0"]),
        ("Section iv. 2 copies. MIT License. v. 2", ["MIT"]),
    ],
)
def test_a_version_number_stays_with_its_sentence(spark, text, want):
    (r,) = rows_of(licences.scan(docs_of(spark, [(1, text, "en", "s")])))
    assert r["licences"] == want


def test_every_known_sentence_survives_the_cut(spark):
    known = list(licences.SENTENCES.items())
    docs = [(i, f"Before this. {sentence}. After it", "en", "s") for i, (sentence, _) in enumerate(known)]
    got = {r["doc_id"]: r["sentences"] for r in rows_of(licences.scan(docs_of(spark, docs)))}
    assert got == {i: [name] for i, (_, name) in enumerate(known)}


def test_query_and_sql_agree_on_mozilla_notices(spark, tmp_path):
    import duckdb

    from scorekit.llm import oracle, queries

    notice = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
    texts = [notice, notice.replace("v. 2.0", "v.\n * 2.0"), "Rev. 2.0 v. b. see v. 3", MIT, GPL, None, ""]
    docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r.values()) for r in rows_of(queries.REGISTRY["op4_licences"](spark, str(tmp_path))))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(oracle.SQL["op4_licences"]).fetchall())
    assert [r[2] for r in got[:2]] == ["MPL-2.0", "MPL-2.0"]
