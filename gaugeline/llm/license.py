"""License scans by canonical digests.

A text is made canonical: lower case (of what lowers to a-z), copyright lines dropped (lines end at \\n), equivalent spellings made one, what is
neither a letter a-z nor a digit made one space; its SHA-256 is looked up among the digests of known
texts by a hash join.  Whole documents are looked up, and so is each of a document's lines, as notices
are whole lines.  The known texts are a fixed table of about a hundred rows, so that side is broadcast: short
licences whole, and of the long ones (Apache, MPL, the GNU and Creative Commons ones) the notices.

Defined cases: null texts, and those without a letter or digit, have a null digest and no license;
a text made of copyright lines only likewise; repeated rows each get their result; an empty table
gives an empty result; extra columns are not looked at; very long texts go whole through the same expressions.  Two known texts with the same canonical form
are an error.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew

#: Lines that name a holder: they differ from copy to copy of a licence.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$|^[^a-z0-9\n]*all rights reserved[^\n]*$"
#: (pattern, spelling), in this order, on lower-case text.
SPELLINGS = ((r"licence", "license"), (r"sub-license", "sublicense"), (r"non-infringement", "noninfringement"), (r"https://", "http://"), (r"whilst", "while"), (r"favour", "favor"), (r"organisation", "organization"), (r"authorised", "authorized"), (r"acknowledgement", "acknowledgment"), (r"per cent", "percent"), (r"copyright owner", "copyright holder"), (r"\bv(ersion)? ?([0-9])", "version $2"))

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: The notices that the long licences ask for in place of their text.
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def gnu_notice(name: str, version: str, what: str = "program") -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""


#: (license, text): whole licences, with and without their title, the notices of long ones, and one-line notices.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC_USE + ISC_KEEP + ISC_END[1:]),
    ("ISC", "ISC License\n\n" + ISC_USE + ISC_KEEP + ISC_END[1:]),
    ("0BSD", ISC_USE + ISC_END),
    ("BSD-2-Clause", BSD_HEAD + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_END),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAME + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_NAME + BSD_END),
    ("Zlib", ZLIB),
    ("Unlicense", UNLICENSE),
    ("BSL-1.0", BSL),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BSL),
    ("Apache-2.0", APACHE_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    *((f"{short}-{version}-or-later", gnu_notice(name, number, what)) for short, name in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")) for version, number in (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3")) for what in ("program", "library", "software")),
    *((f"{name}", f"{lead} {what}.") for name, whats in (
        ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0")),
        ("MIT", ("the MIT License",)),
        ("GPL-2.0", ("the GNU General Public License, version 2",)),
        ("GPL-3.0", ("the GNU General Public License, version 3",)),
        ("LGPL-3.0", ("the GNU Lesser General Public License, version 3",)),
        ("MPL-2.0", ("the Mozilla Public License, version 2.0",)),
        ("CC-BY-4.0", ("CC BY 4.0",)),
        ("CC-BY-SA-4.0", ("CC BY-SA 4.0",)),
        ("CC-BY-NC-4.0", ("CC BY-NC 4.0",)),
        ("CC0-1.0", ("CC0 1.0",)),
    ) for what in whats for lead in ("Licensed under", "Released under", "This work is licensed under", "This software is licensed under", "Available under")),
    *((f"{name}", f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC-BY-4.0", "CC0-1.0")),
)


#: The characters whose lower case is one of a-z; of others the case doesn't matter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0130\u212a", "abcdefghijklmnopqrstuvwxyzik"


def canonical_text(text: str) -> str:
    """What canonical() makes of a text."""
    t = re.sub(COPYRIGHT, "", text.translate(str.maketrans(UPPER, LOWER)))
    for a, b in SPELLINGS:
        t = re.sub(a, b.replace("$", "\\"), t, flags=re.ASCII)
    return re.sub(r"[^a-z0-9]+", " ", t).strip(" ")


def lowered(col) -> F.Column:
    """Lower case; what that gives of characters that don't lower to a-z makes no difference, but for the dot that it leaves of U+0130."""
    return F.lower(F.replace(col, F.lit("\u0130"), F.lit("i")))


def canonical(col) -> F.Column:
    """Lines end at \\n alone, and only ASCII letters, digits and _ are parts of words, as in other engines' patterns."""
    t = F.regexp_replace(lowered(col), COPYRIGHT.replace("(?m)", "(?dm)"), "")
    for a, b in SPELLINGS:
        t = F.regexp_replace(t, a.replace(r"\b", "(?<![A-Za-z0-9_])"), b)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def digest(col) -> F.Column:
    c = canonical(col)
    return F.when(c != "", F.sha2(c, 256))


def known_digests(known=KNOWN) -> dict[str, str]:
    """digest -> license."""
    out: dict[str, str] = {}
    for name, text in known:
        d = hashlib.sha256(canonical_text(text).encode()).hexdigest()
        if out.setdefault(d, name) != name:
            raise ValueError(f"{name} and {out[d]} have the same canonical text")
    return out


def needed_words(known=KNOWN) -> list[str]:
    """Words of which a text must hold one, in lower case, to have a known digest; none if there are no such words.

    Of each known text, the longest word of letters a-z that no spelling makes or changes: canonical() can't make
    it of other letters, so it is in the text as it stands.
    """
    made = {w for _, b in SPELLINGS for w in re.findall("[a-z]+", b)}
    out = set()
    for _, text in known:
        own = {w for w in canonical_text(text).split() if re.fullmatch("[a-z]+", w) and not any(m in w for m in made)}
        if not own:
            return []
        out.add(max(own, key=lambda w: (len(w), w)))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=KNOWN) -> DataFrame:
    """doc_id, digest, license (of the whole text), notices (licenses of lines, sorted, by commas) of every row."""
    table = known_digests(known)
    if len(table) > 10_000:
        raise ValueError("a table of this size is not to be broadcast")
    rows = F.broadcast(docs.sparkSession.createDataFrame(sorted(table.items()), "known string, found string"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    lines = d.select("doc_id", "key", F.explode(F.split("text", r"\n+")).alias("line")).where("line <> ''")
    words = needed_words(known)
    if words:
        lines = lines.where(lowered("line").rlike("|".join(words)))
    hits = lines.join(rows, digest(F.col("line")) == F.col("known")).groupBy("doc_id", "key").agg(F.array_join(F.sort_array(F.collect_set("found")), ",").alias("notices"))
    # dealt anew, so that many rows of one id and text can be split
    hits = hits.select(dealt_anew("doc_id").alias("hit_id"), dealt_anew("key").alias("hit_key"), "notices")
    whole = d.select("doc_id", "key", digest(F.col("text")).alias("digest")).join(rows, F.col("digest") == F.col("known"), "left")
    out = whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return out.select("doc_id", "digest", F.col("found").alias("license"), "notices")


def license_sql(known=KNOWN) -> str:
    """What scan gives."""

    def made(col: str) -> str:
        t = f"regexp_replace(lower({col}), '{COPYRIGHT.replace('(?m)', '(?m)')}', '', 'g')"
        for a, b in SPELLINGS:
            t = f"regexp_replace({t}, '{a}', '{b.replace('$', chr(92))}', 'g')"
        return f"nullif(trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'), ' '), '')"

    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests(known).items()))
    return f"""
WITH known(k, found) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split_regex(text, '\\n+')) AS line FROM d),
hits AS (SELECT r, string_agg(DISTINCT found, ',' ORDER BY found) AS notices FROM lines JOIN known ON sha256({made("line")}) = k GROUP BY r)
SELECT doc_id, sha256({made("text")}) AS digest, found AS license, notices FROM d LEFT JOIN hits USING (r) LEFT JOIN known ON k = sha256({made("text")})
"""
