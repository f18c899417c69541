"""Licence scans by canonical digest: normalise the whole text, hash it, join known digests.

Case, punctuation, white space, line breaks, copyright notices, a title in front and equivalent
spellings (British and American, symbols and words) are folded; the SHA-256 of what remains
meets the digests of the known texts. A line is a notice if it has a copyright mark and a year
(or a place for one), or word and sign together; if it begins with the word, and a name follows,
and its paragraph has nothing but notices; or if it says "all rights reserved" alone. So a
clause may be broken before the word "copyright" anywhere. Defined results: a null or empty text, or one of punctuation and
copyright lines only, has a digest of the empty text and no licence; repeated rows each
get their answer; of two names for one text the smaller wins; columns of the input that have
the name of a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, let, small_side, without

#: Equivalent spellings, applied to whole words after punctuation is gone.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("favour", "favor"), ("organisation", "organization"),
    ("recognised", "recognized"), ("whilst", "while"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"),
]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: name: whole text. The one-line notices are whole texts too when nothing else stands beside them.
KNOWN = {
    "MIT": MIT,
    "ISC": ISC,
    "Zlib": ZLIB,
    "0BSD": ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "BSD-2-Clause": BSD_CONDITIONS + BSD_DISCLAIMER,
    "BSD-3-Clause": BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER,
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
#: Digests, as digest() gives them, of the published whole texts of further licences.
DIGESTS = {
    "Apache-2.0": "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "BSD-3-Clause-UC": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
_MARK = r"(copyright|\(c\)|\x{a9}|&copy;)"
_YEAR = r"([0-9]{4}|[\[<{(] *(year|yyyy)|(year|yyyy)[\]>})])"
#: Anywhere: mark and year, word and sign, or the reservation alone.
NOTICE = rf"^[^a-z0-9\x{{a9}}(&]*({_MARK}([\s,:;-]|{_MARK}|by )*{_YEAR}|copyright[\s,:]*(\(c\)|\x{{a9}}|&copy;)|(\(c\)|\x{{a9}}|&copy;)[\s,:]*copyright|all rights reserved[^a-z0-9]*$)"
#: Where the paragraph has nothing else: the word and a name, which is none of the words that clauses go on with.
NAMED = r"^[^a-z0-9]*copyright[\s,:]+[^\s]"
CLAUSE = r"^[^a-z0-9]*copyright[\s,:]+(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|disclaimers?|and|or|in|is|of|to|for|on|under|protection|treaty|act)\b"
MARKED = r"copyright|\(c\)|\x{a9}|&copy;|all rights reserved"
BLANK = r"^[^a-z0-9\x{80}-\x{10ffff}]*$"
#: Titles as canonical words; one in front of a text goes.
TITLES = [
    "the mit license mit", "the mit license", "mit license", "isc license isc", "the isc license", "isc license", "the zlib license", "zlib license", "zlib libpng license", "bsd zero clause license", "zero clause bsd license",
    "bsd 2 clause license", "bsd 2 clause simplified license", "the 2 clause bsd license", "simplified bsd license", "the bsd 2 clause license", "bsd 3 clause license", "the 3 clause bsd license", "new bsd license",
    "bsd 3 clause new or revised license", "modified bsd license", "the bsd 3 clause license", "the bsd license", "bsd license",
]
TITLE = f"^({'|'.join(sorted(TITLES, key=len, reverse=True))}) "
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def without_notices(text: Column) -> Column:
    """A text in small letters without the lines that are copyright notices."""
    t = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())
    # Of each line: blank (b), a notice (n), a name behind the word (c), or text (t).
    kind = lambda x: F.when(x.rlike(BLANK), "b").when(x.rlike(NOTICE), "n").when(x.rlike(NAMED) & ~x.rlike(CLAUSE), "c").otherwise("t")
    settled = lambda p: F.when(F.contains(p, F.lit("t")), p).otherwise(F.replace(p, F.lit("c"), F.lit("n")))

    def kept(lines: Column) -> Column:
        kinds = F.array_join(F.transform(F.split(F.array_join(F.transform(lines, kind), ""), "b"), settled), "b")
        return let(kinds, lambda k: F.array_join(F.filter(lines, lambda _, i: F.substring(k, i + 1, F.lit(1)) != "n"), "\n"))

    return F.when(t.rlike(MARKED), let(F.split(t, "\n"), kept)).otherwise(t)


def canonical(text: Column) -> Column:
    """Words of the text without notices and title, in small letters and one spelling, single-spaced."""
    t = F.concat(F.lit(" "), F.regexp_replace(without_notices(text), NOT_WORD, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.regexp_replace(F.trim(F.regexp_replace(t, " +", " ")), TITLE, "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """known, license: of whole texts and of digests made elsewhere."""
    bodies = spark.createDataFrame(list(known.items()), "license string, body string").select("license", digest(F.col("body")).alias("known"))
    made = spark.createDataFrame(list(digests.items()), "license string, known string")
    return bodies.union(made).groupBy("known").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its canonical digest and, if that is known, the licence."""
    known = known_digests(docs.sparkSession) if known is None else known
    out = without(docs, ["digest", "license", "known"]).withColumn("digest", digest(F.col(text)))
    return out.join(small_side(known, 256), F.col("digest") == F.col("known"), "left").drop("known")
