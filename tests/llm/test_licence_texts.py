"""Licence recognition on the standard texts, as they are wrapped in files, and unwrapped."""

import re

import pytest

MIT = """MIT License

Copyright (c) 2020 Somebody

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GNU = """    This {what} is free software{cut} you can redistribute it and/or modify
    it under the terms of the {name} as published by
    the Free Software Foundation{end} either version {v} of the License, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
TEXTS = {
    "mit-full": (MIT, "MIT"),
    "bsd-3": (BSD % THIRD, "BSD-3-Clause"),
    "bsd-2": (BSD % "", "BSD-2-Clause"),
    "gpl3-header": (GNU.format(what="program", cut=":", name="GNU General Public License", end=",", v="3"), "GPL-3.0-or-later"),
    "gpl2-header": (GNU.format(what="program", cut=";", name="GNU General Public License", end=";", v="2"), "GPL-2.0-or-later"),
    "lgpl21-header": (GNU.format(what="library", cut=";", name="GNU Lesser General Public License", end=";", v="2.1"), "LGPL-2.1-or-later"),
    "lgpl3-header": (GNU.format(what="library", cut=":", name="GNU Lesser General Public License", end=",", v="3"), "LGPL-3.0-or-later"),
    "agpl3-header": (GNU.format(what="program", cut=":", name="GNU Affero General Public License", end=",", v="3"), "AGPL-3.0-or-later"),
    "apache-header": (APACHE, "Apache-2.0"),
    "apache-text": ("                                 Apache License\n                           Version 2.0, January 2004\n\n   1. Definitions.", "Apache-2.0"),
    "gpl3-text": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    "agpl3-text": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n", "AGPL-3.0"),
    "zlib-full": (ZLIB, "Zlib"),
    "isc": (ISC, "ISC"),
    "0bsd": ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
    "mpl2-reference": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    "unlicense-reference": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"),
    "cc0-text": ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n", "CC0-1.0"),
    "epl2-text": ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM", "EPL-2.0"),
}


@pytest.fixture(scope="module")
def found(spark):
    from lamella.llm.licences import scan

    unwrapped = lambda t: re.sub(r"(?<!\n)\n(?!\n)", " ", t)
    rows = []
    for k, (text, _) in enumerate(TEXTS.values()):
        rows += [(3 * k, text), (3 * k + 1, unwrapped(text)), (3 * k + 2, "Some words before.\n\n" + text + "\n\nand after it.\n" * 3)]
    got: dict = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.licence, r.rule))
    return got


@pytest.mark.parametrize("rule", list(TEXTS))
def test_standard_text(found, rule):
    k = list(TEXTS).index(rule)
    for form in range(3):
        assert (TEXTS[rule][1], rule) in found.get(3 * k + form, ()), form
        assert {x for x, _ in found[3 * k + form]} == {TEXTS[rule][1]}, form


def test_no_rule_twice(found, spark):
    from lamella.llm.licences import scan

    one = scan(spark.createDataFrame([(1, TEXTS["lgpl3-header"][0] + "\n\n" + TEXTS["lgpl3-header"][0])], "doc_id long, text string")).collect()
    assert [(r.rule, r.n_found) for r in one] == [("lgpl3-header", 2)]
