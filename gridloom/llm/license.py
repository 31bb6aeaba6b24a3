"""Licence scans by canonical digests, with built-in functions alone.

A text is normalised (ASCII case, copyright lines, equivalent spellings, punctuation, white
space) and hashed; the digest of the entire text is joined with those of known licences. Lines that
name a licence are looked up the same way among the digests of known one-line notices. The licence
table (``licences.json``: full texts, each with its titles and without) is a constant of about a hundred rows, so both look-ups stay local to the text's row.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that state who holds the copyright differ from copy to copy.
COPYRIGHT_LINE = r"(?m)^[^\n]*(copyright [(]c[)]|copyright [0-9]|copyright ©|©)[^\n]*$"
#: Spellings that licence texts use for one another.
SPELLINGS = (("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
             ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and "))
PUNCTUATION = r"[^\p{L}\p{N}]+"

_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
             "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
             "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_END = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
            "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
            "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
#: (id, text) of whole licences; one of several titles and bodies may be known under one id.
TEXTS = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
                   "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)


def _catalogue():
    """(id, text) of each full text under each of its titles and under none, whole and up to where its terms end."""
    for x in json.loads(pkgutil.get_data(__package__, "licences.json")):
        bodies = [x["text"]]
        if x["end"]:
            terms = x["text"].split(x["end"])[0]
            bodies += [terms + x["end"], terms]
        for body in bodies:
            for title in [*x["titles"], ""]:
                yield x["id"], f"{title}\n\n{body}".strip()


TEXTS += tuple(x for x in _catalogue() if x not in TEXTS)
#: (id, line) of notices that name a licence in one line.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


def canonical(text) -> F.Column:
    """A text's canonical form: lower-case words and numbers, single blanks between them."""
    x = F.translate(text, UPPER, LOW)
    # Most texts have no such line, and finding none is much cheaper than replacing none.
    x = F.when(x.contains("copyright") | x.contains("©"), F.regexp_replace(x, COPYRIGHT_LINE, " ")).otherwise(x)
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, PUNCTUATION, " "))


def digest(text) -> F.Column:
    return F.sha2(canonical(text), 256)


def known(spark, texts=TEXTS) -> DataFrame:
    """digest, license_id of known texts; the first id of equal digests."""
    return (spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "i int, license_id string, text string")
            .groupBy(digest(F.col("text")).alias("digest")).agg(F.min_by("license_id", "i").alias("license_id")))


def scan(docs: DataFrame, texts=TEXTS, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, license_id, notices.

    digest is the SHA-256 of the canonical whole text, license_id the known licence it is (or null), notices the
    sorted ids, joined by commas, of the known one-line notices among its lines. A null text counts as empty and,
    like any text without letters and digits, is no licence. Repeated rows give a row each; an empty table gives an empty result;
    other columns are ignored.
    """
    if len(texts) > 10_000:
        raise ValueError("more licences than a broadcast should hold")
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, UPPER, LOW).contains("licen"))
    table = F.create_map(*[c for i, x in dict((x, i) for i, x in reversed(notices)).items() for c in (digest(F.lit(i)), F.lit(x))]) if notices else None
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(table, digest(x))), lambda x: x.isNotNull()))), ",") if notices else F.lit("")
    # Only texts with such a line pay for the look-ups.
    said = F.when(F.translate("text", UPPER, LOW).contains("licen"), found).otherwise("")
    d = d.select("doc_id", digest(F.col("text")).alias("digest"), said.alias("notices"))
    return d.join(F.broadcast(known(spark, texts)), "digest", "left").select("doc_id", "digest", "license_id", "notices")
