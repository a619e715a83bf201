"""License scans by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form: lower case, without copyright lines, with one spelling of equivalent words, and with
punctuation and white space as single spaces. The digest of the whole form is joined by hash with the digests of the known
licences. The same is done with the lines and paragraphs of a text, as most statements are a line of a longer text.
"""

from __future__ import annotations

import hashlib
import re
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of a notice: they begin with a copyright mark, or with the word and soon a mark, a year or a place for one. A line of
#: a licence's body that begins with the word stays.
COPYRIGHT_LINES = r"(?m)^[^a-z0-9\n]*(copyright[^\n]{0,40}(\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
# Words that licence comparison guidelines hold equivalent, and the spelling kept.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("recognised", "recognized"),
    ("rights owner", "copyright owner"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
# Short public licence texts, with the titles that may stand before them.
KNOWN = (
    (
        "MIT",
        ("MIT License", "The MIT License (MIT)", "The MIT License",),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        ("ISC License",),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        ("BSD Zero Clause License", "Zero-Clause BSD",),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        ("BSD 2-Clause License", "The 2-Clause BSD License",),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        ("BSD 3-Clause License", "The 3-Clause BSD License",),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Unlicense",
        ("The Unlicense",),
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    (
        "Zlib",
        ("zlib License", "The zlib/libpng License",),
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
)
# Notices, and licences with a notice in SPDX form.
NOTICES = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
)
SPDX = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
# Digests of canonical forms of long licence texts, as Debian's base-files ships them.
DIGESTS = (
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
#: Words of the shortest paragraph that tells a licence by itself.
LEAST_WORDS = 8
BLANK_LINES = r"\n[ \t\r]*\n"
#: Of lines and paragraphs, only ones that have one of these are looked up in the default table, whose forms all have one.
MARKERS = "licen|permission|redistribution|software|spdx"


def canonical(text: Column) -> Column:
    """The canonical form of a text; of a null one that of an empty one."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINES, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))
    # with two blanks between words, neighbours that are both spelled anew don't share one
    spelled = F.replace(out, F.lit(" "), F.lit("  "))
    for said, kept in SPELLINGS:
        spelled = F.replace(spelled, *(F.lit(f" {x} ".replace(" ", "  ")[1:-1]) for x in (said, kept)))
    spelled = F.replace(spelled, F.lit("  "), F.lit(" "))
    some = "|".join(said for said, _ in SPELLINGS)
    return F.trim(F.when(out.rlike(some), spelled).otherwise(out))


def plain_canonical(text: str) -> str:
    """The same form of a known text."""
    out = re.sub(COPYRIGHT_LINES, " ", text.translate(str.maketrans(UPPER, LOWER)))
    out = " " + re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", out) + " "
    for said, kept in SPELLINGS:
        while f" {said} " in out:
            out = out.replace(f" {said} ", f" {kept} ")
    return out.strip(" ")


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of KNOWN, each with and without its titles."""
    return [(i, f"{t}\n\n{body}" if t else body) for i, titles, body in KNOWN for t in ("", *titles)]


def notices() -> list[tuple[str, str]]:
    forms = [(f"{i}-notice", f"SPDX-License-Identifier: {i}{more}") for i in SPDX for more in ("", "-only", "-or-later") if not more or "GPL" in i]
    return [*NOTICES, *forms]


def find_licenses(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (SHA-256 of the canonical form), license_id (null: the text as a whole is no
    known licence), stated (the licences that its lines and paragraphs state, in order of the id, joined by commas).

    ``licenses`` (license_id, text) default to KNOWN, the notices and DIGESTS; of several with one digest the least id counts,
    and ones without any word are left out. A line or paragraph states a licence if it is its whole text, or a paragraph of it
    of LEAST_WORDS words or more that no other licence has. A null or empty text has the digest of an empty form and states
    nothing; a null doc_id stays null; repeated rows are looked up each; of an empty table nothing is returned; other columns
    are ignored, whatever they are called. Texts are compared whole. Digests are joined by hash, and Spark broadcasts those of
    the licences only while they are small.
    """
    spark = docs.sparkSession
    given = licenses is not None
    own = licenses.select("license_id", "text") if given else spark.createDataFrame([*known_texts(), *notices()], "license_id string, text string")
    paragraphs = F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), BLANK_LINES))
    wholes = own.select("license_id", canonical(F.col("text")).alias("form"), F.lit(True).alias("whole"))
    pieces = own.select("license_id", paragraphs.alias("part")).select("license_id", canonical(F.col("part")).alias("form"), F.lit(False).alias("whole"))
    pieces = pieces.filter(F.size(F.split("form", " ")) >= LEAST_WORDS)
    if not given:
        pieces = pieces.filter(F.col("form").rlike(MARKERS))
    forms = wholes.unionAll(pieces).filter("form <> ''").select("license_id", "whole", F.sha2("form", 256).alias("digest"))
    if not given:
        forms = forms.unionAll(spark.createDataFrame([(i, True, d) for i, d in DIGESTS], forms.schema))
    least = F.min(F.when(F.col("whole"), F.col("license_id")))
    known = forms.groupBy("digest").agg(least.alias("by_whole"), F.min("license_id").alias("low"), F.max("license_id").alias("high"))
    any_of = known.select("digest", F.coalesce("by_whole", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("stated_id")).filter("stated_id is not null")

    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    row = F.xxhash64("doc_id", "text")
    marked = F.lit(True) if given else F.lower("text").rlike(MARKERS)
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", BLANK_LINES)))
    if not given:
        parts = F.filter(parts, lambda p: F.lower(p).rlike(MARKERS))
    asked = texts.filter(marked).select(row.alias("row"), F.explode(parts).alias("part"))
    asked = asked.select("row", F.coalesce(F.sha2(canonical(F.col("part")), 256), F.lit("")).alias("digest"))
    stated = asked.join(any_of, "digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("stated_id")), ",").alias("stated"))

    digest = F.coalesce(F.sha2(canonical(F.col("text")), 256), F.lit(""))  # never null, else the join's test for null computes it twice
    rows = texts.select("doc_id", row.alias("row"), digest.alias("digest"))
    out = rows.join(known.select("digest", F.col("by_whole").alias("license_id")), "digest", "left").join(stated, "row", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("stated", F.lit("")).alias("stated"))


def planted(spark: SparkSession) -> DataFrame:
    """Known texts as files have them: (doc_id, text), one for each of ``planted_rows``."""
    return spark.createDataFrame([(d, text) for d, _, text in planted_rows()], "doc_id bigint, text string")


def planted_rows() -> list[tuple[int, str | None, str]]:
    """(doc_id, license_id, text): each known text as it is, wrapped, with a notice, and with a word more."""
    out = []
    for i, text in known_texts():
        wrapped = "\n\n".join(textwrap.fill(p, 70) for p in text.split("\n\n"))
        title, _, rest = wrapped.partition("\n\n")
        dated = f"{title}\n\nCopyright (c) 2019-2021 Ann Example\nAll rights reserved.\n\n{rest}"
        out += [(i, text), (i, wrapped), (i, dated.upper()), (None, f"{wrapped}\nmore")]
    return [(d, i, text) for d, (i, text) in enumerate(out)]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(text: str) -> str:
    out = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {_quoted(COPYRIGHT_LINES)}, ' ', 'g')"
    out = f"replace(' ' || regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g') || ' ', ' ', '  ')"
    for said, kept in SPELLINGS:
        said, kept = (x.replace(" ", "  ") for x in (said, kept))
        out = f"replace({out}, ' {said} ', ' {kept} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _digests() -> tuple[dict[str, str], dict[str, str]]:
    """By digest, the licence that a whole text is, and the one that a part states."""
    own = [*known_texts(), *notices()]
    digest = lambda form: hashlib.sha256(form.encode()).hexdigest()
    whole: dict[str, str] = {}
    for i, d in [*((i, digest(plain_canonical(t))) for i, t in own), *DIGESTS]:
        whole[d] = min(whole.get(d, i), i)
    holders: dict[str, set] = {}
    for i, t in own:
        for form in map(plain_canonical, re.split(BLANK_LINES, t)):
            if len(form.split(" ")) >= LEAST_WORDS and re.search(MARKERS, form):
                holders.setdefault(digest(form), set()).add(i)
    return whole, {d: min(i) for d, i in holders.items() if len(i) == 1} | whole


def oracle_sql() -> str:
    """DuckDB's SQL for the rows of ``find_licenses`` over documents."""
    whole, any_of = (", ".join(f"('{d}', '{i}')" for d, i in sorted(x.items())) for x in _digests())
    return f"""
with rows as (select row_number() over () as rn, doc_id, coalesce(text, '') as text from documents),
whole as (select * from (values {whole}) as t(digest, license_id)),
any_of as (select * from (values {any_of}) as t(digest, license_id)),
parts as (select rn, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, {_quoted(BLANK_LINES)}))) as part from rows where regexp_matches(lower(text), '{MARKERS}')),
asked as (select rn, sha256({_form("part")}) as digest from parts where regexp_matches(lower(part), '{MARKERS}')),
stated as (select rn, string_agg(distinct license_id, ',' order by license_id) as stated from asked join any_of using (digest) group by rn),
digests as (select rn, doc_id, sha256({_form("text")}) as digest from rows)
select doc_id, digest, license_id, coalesce(stated, '') as stated from digests left join whole using (digest) left join stated using (rn)"""


def planted_sql() -> str:
    rows = ", ".join(f"({d}, {_quoted(i) if i else 'null'})" for d, i, _ in planted_rows())
    return f"select cast(doc_id as bigint) as doc_id, license_id from (values {rows}) as t(doc_id, license_id)"
