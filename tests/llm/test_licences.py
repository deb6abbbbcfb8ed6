import duckdb
import pytest

from korrel.llm import licences

CASES = {
    "Some text here.\nReleased under the MIT License.": "MIT",
    "x. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "THIS WORK is licensed under the GNU General Public License, version 3!": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.\nAll rights reserved.": "CC-BY-NC-4.0,Proprietary",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1 text\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "",
    "the mit license is short": "",
    "": "",
    None: "",
    " \n..\n?!": "",
}


@pytest.fixture(scope="module")
def rows(spark, make_docs):
    return sorted(licences.scan(make_docs([*CASES, *CASES])).collect(), key=lambda r: r.doc_id)


def test_rules(rows):
    assert [r.licences for r in rows] == [*CASES.values(), *CASES.values()]
    assert rows[4].n_sentences == 4 and rows[4].sentence_ids == "redistribution-bsd,source-bsd,binary-bsd,endorse-bsd"


def test_sql_agrees(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate([*CASES, *CASES])))
    assert sorted(con.execute(f"select doc_id, n_sentences, sentence_ids, licences from ({licences.sql()})").fetchall()) == [tuple(r) for r in rows]


def test_no_python_and_no_shuffle(spark, make_docs):
    docs = make_docs(["x"]).withColumnRenamed("lang", "ids")
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert licences.scan(make_docs([])).collect() == []


def test_every_sentence_is_in_normal_form(spark, make_docs):
    every = [(s, i) for i, x in licences.SENTENCES.items() for s in x]
    got = licences.scan(make_docs([s for s, _ in every])).collect()
    assert [r.sentence_ids for r in sorted(got, key=lambda r: r.doc_id)] == [i for _, i in every]
    assert {i for _, rule in licences.RULES for i in rule} <= licences.SENTENCES.keys()
    assert all(c.isalpha() for c in licences.CUES) and all(any(c in s for c in licences.CUES) for s, _ in every)


MIT = """MIT License
Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
ISC = """Copyright (c) 2020 A Person
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law"""
LGPL = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
AGPL = GPL.replace("the GNU General", "the GNU Affero General").replace("\nGNU General", "\nGNU Affero General")
GPL2 = GPL.replace("version 3", "version 2").replace("program is free software:", "program is free software;")
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
BOTH = f"{BSD}\nReleased under the MIT License.\n\n{BSD3}"
TWICE = f"{BSD3}\n{BSD3}"
WRAPPED = {LGPL: "LGPL-2.1-or-later", AGPL: "AGPL-3.0-or-later", GPL2: "GPL-2.0-or-later", EPL: "EPL-2.0", UNLICENSE: "Unlicense", ZLIB: "Zlib", BSD3: "BSD-3-Clause", TWICE: "BSD-3-Clause", BOTH: "BSD-2-Clause,BSD-3-Clause,MIT", MIT: "MIT", ISC: "ISC", BSD: "BSD-2-Clause", GPL: "GPL-3.0-or-later", MPL: "MPL-2.0", APACHE: "Apache-2.0-notice"}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- "])
def test_wrapped_notices(spark, make_docs, mark):
    texts = ["\n".join((mark + x).rstrip() for x in t.split("\n")) for t in WRAPPED]
    texts += [t.replace("\n", "\r\n") for t in texts] + ["int x\n" * 2000 + "\n".join(t.split("\n")) for t in WRAPPED]
    got = sorted(licences.scan(make_docs(texts)).collect(), key=lambda r: r.doc_id)
    assert [r.licences for r in got] == [*WRAPPED.values()] * 3


@pytest.mark.parametrize("text,want", [("MIT License\n\nCopyright (c) A", ""), ("Licensed under the\nMIT License.", "MIT"), (" ".join(MIT.split()), "MIT"), (" ".join(BSD3.split()), "BSD-3-Clause"), (" ".join(GPL.split()), "GPL-3.0-or-later")])
def test_other_forms(make_docs, text, want):
    assert licences.scan(make_docs([text])).first().licences == want


def test_very_long_text(make_docs):
    text = "word " * 400_000 + ". Released under the MIT License.\n" + "x; " * 100_000
    assert licences.scan(make_docs([text])).first().licences == "MIT"
