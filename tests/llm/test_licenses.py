"""Whole licence texts as projects ship them, wrapped as usual, against the operator and its SQL."""

import duckdb
import pandas as pd

from gridloom.llm import license_scan, oracles

COPYRIGHT = "Copyright (c) 2021 Jane Doe\n"
MIT = """MIT License

Copyright (c) 2021 Jane Doe

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
SOFTWARE.
"""
MIT_0 = MIT.replace("MIT License", "MIT No Attribution").replace("so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.", "so.")
BSD_HEAD = """Copyright (c) 2021, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3RD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_4TH = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by Jane Doe.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ISC = """ISC License

Copyright (c) 2021 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES.
"""
ZLIB = """Copyright (c) 2021 Jane Doe

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
GPL_NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {kind}General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL_2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
WHOLE = {
    MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", MIT_0: "MIT-0", BSD_HEAD + BSD_TAIL: "BSD-2-Clause", BSD_HEAD + BSD_3RD + BSD_TAIL: "BSD-3-Clause", BSD_HEAD + BSD_4TH + BSD_TAIL: "BSD-4-Clause",
    ISC: "ISC", ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""): "0BSD", ZLIB: "Zlib", UNLICENSE: "Unlicense",
    GPL_NOTICE.format(kind=""): "GPL-3.0-or-later", GPL_NOTICE.format(kind="Lesser "): "LGPL-3.0-or-later", GPL_NOTICE.format(kind="Affero "): "AGPL-3.0-or-later", GPL_2: "GPL-2.0-or-later", MPL: "MPL-2.0", APACHE: "Apache-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989": "GPL-2.0", "Apache License\n   Version 2.0, January 2004\n": "Apache-2.0",
    "// SPDX-License-Identifier: LGPL-2.1-or-later\nint main;": "LGPL-2.1-or-later", BSD_HEAD + BSD_TAIL + "\n\n" + BSD_HEAD + BSD_3RD: "BSD-2-Clause,BSD-3-Clause", MIT + "\n\n" + ISC: "ISC,MIT",
    BSD_HEAD.replace("1. Red", "Red").replace("2. Red", "Red").replace("\n   ", " ") + BSD_3RD: "BSD-3-Clause", "The permission of the author is needed.": "", MIT.replace("THE SOFTWARE IS", "THIS WORK IS"): "",
}


def test_whole_texts_and_sql(spark):
    rows = [(i, t) for i, t in enumerate(WHOLE)] + [(900, None), (901, ""), (902, f"{APACHE}\n{APACHE}")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id", ignore_index=True)
    assert dict(zip(got.doc_id, got.licenses)) == dict(enumerate(WHOLE.values())) | {900: "", 901: "", 902: "Apache-2.0"}
    with duckdb.connect() as c:
        c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
        told = c.execute(oracles.licenses()).df().sort_values("doc_id", ignore_index=True)
    assert got.equals(told)


def test_more_than_twenty_licences():
    assert len({name for name, _ in license_scan.RULES}) > 25
    # A rule stands behind every longer one that holds it.
    for i, (_, ids) in enumerate(license_scan.RULES):
        assert not any(ids != more and "".join(f"<{x}>" for x in ids) in "".join(f"<{x}>" for x in more) for _, more in license_scan.RULES[i + 1 :])
