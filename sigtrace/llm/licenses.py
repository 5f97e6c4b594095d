"""Licence scan by canonical digests, with DataFrame functions only.

Texts are brought to a canonical form line by line: lower case, punctuation and runs of white
space as one space, copyright lines (with or without a year) and lines that only reserve rights
dropped, equivalent spellings made one.  Units are looked up whole: every document, and every run
of lines that is as long as a known text, wherever its lines break.  The SHA-256 of a unit's
canonical text is joined with the digests of known texts.  Runs are hashed only where a
line begins with the first ``HEAD`` words of a known text.

Known are the short notices and licences in ``KNOWN`` as texts, and longer licences in ``DIGESTS``.

Null and empty texts have no units.  A canonical text that is empty is never looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.operators.sizing import broadcast_if_small, has_at_most

from .rows import only

#: Words by which the start of a known text is found; most known texts in a table with heads.
HEAD, MOST_KNOWN = 4, 10_000

#: Spellings that say the same, applied to canonical words in this order.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("per cent", "percent"),
    ("https ", "http "),
]
#: Lines that name an owner: the word with a sign, a year or a name, or a sign alone; comment marks may stand before.
COPYRIGHT = (
    r"^[^\p{L}\p{N}(©]*(?:(?i:copyright)[\s:]+(?:\([cC]\)|©|[0-9]{4}|<?(?:yyyy|year))|(?:Copyright|COPYRIGHT)[\s:]+(?:by |[A-Z<\[{])|©|\([cC]\)\s+.*[0-9]{4})"
)
#: Lines of licences that begin with the same word.
NO_COPYRIGHT = r"(?i)^[^\p{L}\p{N}]*copyright\s+(?:holder|owner|notice|licen[sc]e|law|statement|interest|protection|act\b|and\b|or\b)"
RESERVED = r"(?i)^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software. " + WARRANTY
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
    "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
    "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
    "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
    "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
    "altered from any source distribution."
)
#: Known licence texts and notices: identifier and text.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. " + WARRANTY,
    ),
    (
        "ISC",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        + ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. " + ISC_WARRANTY,
    ),
    ("MIT", MIT_TERMS),
    ("MIT", "The MIT License " + MIT_TERMS),
    ("MIT", "The MIT License (MIT) " + MIT_TERMS),
    ("BSD-2-Clause", BSD_TERMS + BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License " + BSD_TERMS + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_TERMS + BSD_NAME + BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License " + BSD_TERMS + BSD_NAME + BSD_WARRANTY),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + " For more information, please refer to <https://unlicense.org>"),
    ("Unlicense", UNLICENSE + " For more information, please refer to <https://unlicense.org/>"),
    ("Zlib", ZLIB),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


# -- fixed values: licences by identifier, first words, number of words and SHA-256 of the canonical text, in full, without
# -- their appendix, and without their closing line as well
DIGESTS = [
    ("Apache-2.0", "apache license version 2", 1426, "cb0c3bd3124478210522e8c821ca588654ce01e22f49f7da61cfbc25668b8487"),
    ("Apache-2.0", "apache license version 2", 1431, "408d79782772308fe7ec4aeb2f0b2f9a28dcf9246ddcf0755c43e4d3fb4efa11"),
    ("Apache-2.0", "apache license version 2", 1602, "b86cc8f4ca3b78dc6187c66567d6089a5911bbe4537e1fa0d5d9c38ce1b3749e"),
    ("Artistic-1.0-Perl", "the artistic license preamble", 983, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "redistribution and use in", 214, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "creative commons legal code", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free documentation license", 3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "gnu free documentation license", 3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "gnu general public license", 1636, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "gnu general public license", 1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "gnu general public license", 2067, "490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d"),
    ("GPL-2.0", "gnu general public license", 2499, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "gnu general public license", 2504, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "gnu general public license", 2975, "2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae"),
    ("GPL-3.0", "gnu general public license", 5236, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "gnu general public license", 5241, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "gnu general public license", 5684, "d83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1"),
    ("LGPL-2.0", "gnu library general public", 3860, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "gnu library general public", 3865, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "gnu library general public", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "gnu lesser general public", 4060, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "gnu lesser general public", 4065, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "gnu lesser general public", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "gnu lesser general public", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license version", 3786, "546c591b5dec7c5c257fd6b4f386c65b8965d9beb247dec35bc0dbe0a9053bee"),
    ("MPL-2.0", "mozilla public license version", 2426, "4cabe7a78fd77da2d52b1a2929bf10219e45cfc14279d76a49774370a74b3d17"),
]


def names_an_owner(line: Column) -> Column:
    """Whether a line as written is a copyright line or only reserves rights."""
    return (line.rlike(COPYRIGHT) & ~line.rlike(NO_COPYRIGHT)) | line.rlike(RESERVED)


def with_lines(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but for text, with n, the number of its lines, and ``lines``.

    ``lines`` holds (at, text) of the lines that have canonical words; ``at`` counts from 1.  The canonical
    text is a column of its own on the way, so that it is made once.
    """
    marked = F.lower("text")
    for sign in ("©", "(c)"):
        marked = F.replace(marked, F.lit(sign), F.lit(" copyright "))
    plain = F.regexp_replace(marked, r"[^\p{L}\p{N}\n]+", " ")
    for spelling, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(usual))
    some = lambda t: F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("reserved"))
    # the lines as written are looked at only in texts, and there in lines, that have one of two words
    kept = F.zip_with(
        F.split("plain", "\n"), F.split("text", "\n"), lambda line, raw: F.when(some(line) & names_an_owner(raw), F.lit("")).otherwise(F.trim(line))
    )
    cut = F.when(some(F.col("plain")), kept).otherwise(F.transform(F.split("plain", "\n"), lambda line: F.trim(line)))
    numbered = F.filter(F.transform("cut", lambda line, i: F.struct((i + 1).cast("long").alias("at"), line.alias("text"))), lambda x: x["text"] != "")
    rest = [c for c in rows.columns if c != "text"]
    return rows.withColumn("plain", plain).select(*rest, cut.alias("cut")).select(*rest, F.size("cut").alias("n"), numbered.alias("lines"))


def words_of(line: Column) -> Column:
    return F.size(F.split(line, " "))


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda line: line["text"]), " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_texts(texts: DataFrame) -> DataFrame:
    """(license_id, head, words, digest) of licence texts (license_id, text), by the same functions."""
    rows = with_lines(only(texts, "license_id", "text")).select("license_id", joined(F.col("lines")).alias("text")).where("text <> ''")
    words = words_of(F.col("text"))
    return rows.select("license_id", F.substring_index("text", " ", HEAD).alias("head"), words.alias("words"), digest(F.col("text")).alias("digest")).distinct()


def built_in(spark: SparkSession) -> DataFrame:
    """The known texts of this module."""
    texts = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in KNOWN))
    rows = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(h).alias("head"), F.lit(n).alias("words"), F.lit(d).alias("digest")) for i, h, n, d in DIGESTS))
    one = spark.range(1)
    return known_texts(one.select(F.inline(texts))).unionByName(one.select(F.inline(rows))).distinct()


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, line (0 for the whole text), n_lines, license_id and digest: one row per unit with a known licence.

    ``n_lines`` is the number of lines from the first to the last of a run, and of the whole text for line 0.
    Repeated documents are reported as often as they stand in ``documents``.  ``known`` is a table as
    of ``known_texts``; one of (license_id, digest) alone is looked up by whole texts and single lines.
    """
    rows = with_lines(only(documents, "doc_id", "text"))
    whole = F.struct(F.lit(0).cast("long").alias("line"), F.col("n").cast("long").alias("n_lines"), joined(F.col("lines")).alias("text"))
    if known is not None and "head" not in known.columns:
        table = broadcast_if_small(only(known, "license_id", "digest"))
        each = F.transform("lines", lambda x: F.struct(x["at"].alias("line"), F.lit(1).cast("long").alias("n_lines"), x["text"].alias("text")))
        units = rows.select("doc_id", F.inline(F.concat(F.array(whole), each)))
    else:
        table = built_in(documents.sparkSession) if known is None else only(known, "license_id", "head", "words", "digest")
        if not has_at_most(table, MOST_KNOWN):
            raise ValueError(f"at most {MOST_KNOWN} known texts with heads")
        units = units_of(rows, table)
        table = F.broadcast(table.select("license_id", "digest").distinct())  # MOST_KNOWN rows at most
    found = units.where("text <> ''").select("doc_id", "line", "n_lines", digest(F.col("text")).alias("digest"))
    return found.join(table, "digest").select("doc_id", "line", "n_lines", "license_id", "digest")


def units_of(rows: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, line, n_lines and text of whole texts, and of the runs of lines that begin like a known text and have as many words."""
    sizes = table.select("head", "words").distinct()
    longest = {r["head"]: r["most"] for r in sizes.groupBy("head").agg(F.max("words").alias("most")).collect()}
    counts = sorted({h.count(" ") + 1 for h in longest}) or [HEAD]
    most = F.create_map(*(F.lit(x) for pair in (sorted(longest.items()) or [("", 0)]) for x in pair))

    def head(line: Column, i: Column, n: int) -> Column:
        """The first words from a line on, in most cases its own."""
        own = F.substring_index(line, " ", n)
        on = joined(F.slice("lines", i + 1, n))  # every line has a word at least
        return F.when(own != line, own).otherwise(F.substring_index(on, " ", n))

    def begun(line: Column, i: Column) -> Column:
        """What follows line i, as far as the longest text that begins like it goes."""
        heads = F.array_distinct(F.array(*(head(line["text"], i, n) for n in counts)))
        fitting = F.filter(heads, lambda h: h.isin(sorted(longest)))
        return F.transform(fitting, lambda h: F.struct(h.alias("head"), F.slice("lines", i + 1, F.element_at(most, h)).alias("rest")))

    whole = F.array(F.struct(F.lit(None).cast("string").alias("head"), F.col("lines").alias("rest")))
    # one generator for both, so that the lines are made once
    each = rows.select("doc_id", "n", F.inline(F.concat(whole, F.flatten(F.transform("lines", begun)))))
    sized = each.join(F.broadcast(sizes.withColumnRenamed("head", "begins")), F.col("head") == F.col("begins"), "left")

    def step(s: Column, line: Column) -> Column:
        on = s["words"] < F.col("words")
        return F.struct((s["words"] + F.when(on, words_of(line["text"])).otherwise(0)).alias("words"), (s["lines"] + on.cast("int")).alias("lines"))

    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    is_whole = F.col("head").isNull()
    reached = sized.withColumn("reached", F.when(~is_whole, F.aggregate("rest", none, step)))
    fits = reached.where(is_whole | (F.col("reached.words") == F.col("words")))
    run = F.when(is_whole, F.col("rest")).otherwise(F.slice("rest", F.lit(1), F.col("reached.lines")))
    first, last = F.get("run", F.lit(0))["at"], F.get("run", F.size("run") - 1)["at"]
    cut = fits.select("doc_id", "n", is_whole.alias("whole"), run.alias("run"))
    return cut.select(
        "doc_id",
        F.when(F.col("whole"), F.lit(0)).otherwise(first).cast("long").alias("line"),
        F.when(F.col("whole"), F.col("n")).otherwise(last - first + 1).cast("long").alias("n_lines"),
        joined(F.col("run")).alias("text"),
    )
