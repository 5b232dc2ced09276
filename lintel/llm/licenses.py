"""Licence scan by canonical digest: whole texts are normalised and hash-joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, table, without

#: Spellings that licence matching holds equal, as (words, what stands for them).
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("organisations", "organizations"),
    ("authorised", "authorized"), ("authorisation", "authorization"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"),
    ("noninfringment", "noninfringement"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("catalogue", "catalog"), ("programme", "program"), ("recognise", "recognize"), ("wilful", "willful"), ("https", "http"),
    ("per cent", "percent"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
)

#: White space, as Java and RE2 both have it.
_S = r"[ \t\n\x0B\f\r]"
#: Fixed value: what behind "Copyright" at the start of a line makes it a notice: a sign, a year or its place-holder.
_SIGN = r"(?:\(c\)|©|[0-9]{4}|[\[<{](?:yyyy|year))"
#: A line that is a copyright notice, after lower-casing, or claims all rights and nothing else. A line of running text that begins with the word is none.
NOTICE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t:,]*{_SIGN}|(?:\(c\)|©)[ \t]*(?:copyright[ \t,]*)?[0-9]{{4}}|©)[^\n]*|^[^\p{{L}}\p{{N}}\n]*all rights reserved[^\p{{L}}\p{{N}}\n]*$"
#: The mark of a list's item: (a) b) 3. iv.
MARK = r"\(?(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

MIT_0 = MIT.replace(""" so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", " so.")
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Public licence texts and standard notices, by identifier.
KNOWN = (
    ("MIT-0", MIT_0), ("MIT-0", "MIT No Attribution\n" + MIT_0), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST), ("BSL-1.0", BOOST), ("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>\n".replace("unlicense.org", "www.unlicense.org")), ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER),
    ("MIT", MIT), ("MIT", "MIT License\n" + MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB), ("Zlib", "zlib License\n" + ZLIB),
    ("BSD-2-Clause", f"{BSD_TOP}\n\n{BSD_WARRANTY}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{BSD_TOP}\n\n{BSD_WARRANTY}"), ("BSD-3-Clause", f"{BSD_TOP}\n\n{BSD_THIRD}\n\n{BSD_WARRANTY}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{BSD_TOP}\n\n{BSD_THIRD}\n\n{BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


#: Digests, by this module's own rules, of the whole texts of longer public licences; tests work them out again from the texts, where a system has these.
DIGESTS = (
    ("Apache-2.0", "f5156b991895d728154c9ade7edeea767876ff959f2eceb671088da28cc2228f"),
    ("Apache-2.0", "01bd11c103c65e5db56ce884b600e5986dd03ac5fd8ec02792d3c857e6049a7c"),  # to its end of terms
    ("Apache-2.0", "f8f711704feac48f43eb125ca96dab17a1da5da3343ff1ea06eb7bfae9fb5649"),  # to its end of terms, bare
    ("Artistic-1.0-Perl", "529002857bb70d601700d3446387c8272f3e722d4f046b868501698ed91ca35b"),
    ("CC0-1.0", "8e49653af29e5e2a5a208db334b401d1efc7d4ba4dbb41658c228bf65d8fb111"),
    ("GFDL-1.2", "15df8a529ab79bc230064b956bb839af7f52ae093f89975ea7bb6b6b85e13837"),
    ("GFDL-1.3", "7fb641e3d066b00781f74800f51bb7584a65683c61c13500d2514d69a5153620"),
    ("GPL-1.0", "ab64ac34fae02871b04bbee991d23b8be53f83a581b6cd5f599fd507b4e5dcb3"),
    ("GPL-1.0", "7be29f7e0f8c592fc2644a86908b0a492765b519ebedb93af8f37a948ecea801"),  # to its end of terms
    ("GPL-1.0", "774861d3bd19e7e33504af1ff4bdfafa434c3323320173f796d1fdc4c64d79dd"),  # to its end of terms, bare
    ("GPL-2.0", "2979408bbc9f78e164d3eb8016b1919e58f024df12db38d4e8b7d171a9673f11"),
    ("GPL-2.0", "aecb03c27d261ac2fa4b7bd2991408ec5de88349520cae6084957bebfc5372f6"),  # to its end of terms
    ("GPL-2.0", "4b044d1786b0137843d3bbf7e81042ff3684436290650771b69cd5573199d9e8"),  # to its end of terms, bare
    ("GPL-3.0", "e2994823216ce29dfed3c676875a37ac1b22eae3a3ae9b5658d7f11a0faee0de"),
    ("GPL-3.0", "975612af291d7f831b0ea0e677694ac5f4471a676949fa694c64a5ffd12c4df8"),  # to its end of terms
    ("GPL-3.0", "109a584b4a2b9b32466659591a7dd2f94d033514b2e83c61c2c8e3bcbc9f87e7"),  # to its end of terms, bare
    ("LGPL-2.0", "04e2c570d6bcfbb312db674880f1999fc760d6109be824bc11b5d44f429f4cea"),
    ("LGPL-2.0", "af3d7d66c2c787a851f1dfd24e5114e7ac3392e8b85dcd7077e123badd1b29ac"),  # to its end of terms
    ("LGPL-2.0", "b6ea852d5b615740f15b530c9123f8ba9a7c126434b4dcf62a3e6e03ba129872"),  # to its end of terms, bare
    ("LGPL-2.1", "ca511a276985720ff1761dafe7fb654e0ce0b300fceff7a496ec59f30341ddac"),
    ("LGPL-2.1", "f3a0271347ccf9aad815c652baa0b082f3b77aca4117d1c59fc5a0e1f691abdc"),  # to its end of terms
    ("LGPL-2.1", "368f3743551c4132a8fd9862944ab70ed1d4cefe2feccfcaa470aae51951d47d"),  # to its end of terms, bare
    ("LGPL-3.0", "b8b008b2c618624815be51895bbca0c40ae0529d66951b18db868e0eaba1d42d"),
    ("MPL-1.1", "57710ed88987ea855f93e8f3d3c3f1dbbe6661d1a73ea9321e91bdb83016f0de"),
    ("MPL-2.0", "cb498a876b3ff230d4b105fc7ee90b43f9280dbe093bfd1ad90a504c6d7dfd17"),
)

#: Texts that the registered query scans beside its table, under ids from -1 down: no document of the synthetic tables is a licence as a whole.
PLANTED = (
    "Copyright (c) 2020 Jo Doe\nAll rights reserved.\n\n" + MIT.replace("license", "licence").upper(), "MIT License\n\nCopyright 2019-2021 The Authors\n\n" + MIT.replace(", ", ",\n"),
    f"* Copyright (C) <year> me\n{BSD_TOP}\n\n{BSD_THIRD}\n\n{BSD_WARRANTY}".replace("1. ", "* ").replace("2. ", "(b) ").replace("3. ", "- ").replace("copyright ", "\ncopyright "), ISC.replace(" ", "\t"), ZLIB.replace("\n", "\r\n"), "# " + APACHE_HEADER.replace("\n", "\n# "),
    MPL_HEADER, UNLICENSE.replace("non-commercial", "noncommercial"), "Licensed under the Apache License, Version 1.1.", MIT + " more", MIT.replace("free of charge", "free"), "licence licence", "license license", "Copyright (c) 1999 me", "",
)


def canonical(text: Column) -> Column:
    """The text as licences are compared: lower case; lines that are copyright notices and marks of list items behind other marks go; runs of
    anything but letters and digits are one space; equivalent spellings are one. Null gives ''. How lines are wrapped doesn't matter.
    """
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    x = F.when(x.contains("copyright") | x.contains("©") | x.contains("(c)") | x.contains("all rights reserved"), F.regexp_replace(x, NOTICE, "")).otherwise(x)
    x = F.concat(F.lit("."), F.regexp_replace(F.concat(F.lit(". "), x, F.lit(" ")), rf"(?<=[^\p{{L}}\p{{N}} \t\n\x0B\f\r]){_S}++{MARK}(?={_S})", "."))
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))  # each word has spaces of its own
    for word, other in EQUIVALENT:
        x = F.replace(x, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {other.replace(' ', '  ')} "))
    return F.trim(F.replace(x, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of known texts (license_id, text): one row per digest, with the least identifier; empty texts are none."""
    return known.filter(F.length(canonical(F.col("text"))) > 0).select(digest(F.col("text")).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with `digest`, of its canonical whole text, and `license_id`, that of the known licence of equal digest, else null.

    Null and empty texts, and those of copyright notices alone, have the digest of the empty text and no licence. Rows stay as they are, repeated ones too;
    columns of the added names are replaced. By default the known licences are KNOWN's texts and DIGESTS; other texts (license_id, text) can be given instead. Known digests
    are joined by hash; Spark broadcasts them if they are under its size threshold and deals both sides out by digest, with skewed partitions split, if not.
    """
    spark = docs.sparkSession
    if known is None:
        digests = known_digests(spark.createDataFrame(list(KNOWN), "license_id string, text string")).unionByName(spark.createDataFrame(list(DIGESTS), "license_id string, digest string"))
        digests = digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    else:
        digests = known_digests(known)
    digests = digests.select(F.col("digest").alias("__known"), "license_id")
    left = without(docs, "digest", "license_id").withColumn("digest", digest(F.col(f"`{text}`")))
    return left.join(digests, left["digest"] == digests["__known"], "left").drop("__known")


def op10_license_digests(spark, sf_dir):
    planted = spark.createDataFrame([(-k, t) for k, t in enumerate(PLANTED, 1)], "doc_id long, text string")
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return scan(docs.unionByName(planted)).select("doc_id", "digest", "license_id")


#: The same by lists of lines and words: kept apart from the functions above, so that it shows what these should give.
_SQL = r"""
with eq as (select map([@words], [@others]) as m),
texts as (select doc_id as id, null as license_id, text as t from documents union all select id, null, t from (values @planted) v(id, t) union all select null, license_id, t from (values @known) k(license_id, t)),
lines as (
  select id, license_id, list_aggregate(list_filter(string_split(lower(coalesce(t, '')), chr(10)), lambda l: not (
    regexp_matches(l, '^[^\p{L}\p{N}]*copyright[ \t:,]*(\(c\)|©|[0-9]{4}|[\[<{](yyyy|year))')
    or regexp_matches(l, '^[^\p{L}\p{N}]*(\(c\)|©)[ \t]*(copyright[ \t,]*)?[0-9]{4}') or regexp_matches(l, '^[^\p{L}\p{N}]*©')
    or regexp_full_match(l, '[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*'))), 'string_agg', chr(10)) as t from texts
), tokens as (select id, license_id, list_filter(regexp_split_to_array(coalesce(t, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from lines),
kept as (
  select id, license_id, list_filter(w, lambda x, i: not (regexp_full_match(x, '\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]') and (i = 1 or regexp_matches(w[i - 1], '[^\p{L}\p{N}]$')))) as w from tokens
), words as (select id, license_id, list_transform(regexp_extract_all(array_to_string(w, ' '), '[\p{L}\p{N}]+'), lambda x: coalesce(m[x], x)) as w from kept, eq),
canon as (select id, license_id, @phrases as t from words),
known as (
  select d, min(license_id) as license_id from (
    select sha256(t) as d, license_id from canon where license_id is not null and t <> '' union all select d, license_id from (values @digests) g(license_id, d)) group by d
)
select id as doc_id, sha256(t) as digest, known.license_id from canon left join known on sha256(canon.t) = known.d where canon.license_id is null
""".replace("\\\\", "\\")


def oracle() -> str:
    quoted = lambda s: s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '")
    phrases = "'  ' || array_to_string(w, '    ') || '  '"
    for word, other in EQUIVALENT:
        if " " in word:
            phrases = f"replace({phrases}, '  {word.replace(' ', '    ')}  ', '  {other.replace(' ', '    ')}  ')"
    values = {
        "words": ", ".join(f"'{w}'" for w, _ in EQUIVALENT if " " not in w), "others": ", ".join(f"'{o}'" for w, o in EQUIVALENT if " " not in w),
        "planted": ", ".join(f"({-k}, '{quoted(t)}')" for k, t in enumerate(PLANTED, 1)), "known": ", ".join(f"('{i}', '{quoted(t)}')" for i, t in KNOWN),
        "digests": ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS), "phrases": rf"trim(regexp_replace({phrases}, ' +', ' ', 'g'))",
    }
    sql = _SQL
    for name, value in values.items():
        sql = sql.replace(f"@{name}", value)
    return sql
