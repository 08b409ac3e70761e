"""Licence scans by canonical digest, in DataFrame functions: entire texts are normalised, hashed and joined to known digests.

Normal form: A-Z lower-cased, lines that state a copyright (a mark or the word, and a year; where a licence begins on that line, what
stands before it) and "all rights reserved" lines left out, every run of other characters than letters and digits made one gap, and words of several spellings given
one. So a licence is found in any layout, comment style and year, and for any holder, but only if it is the whole text.

Nulls: a null text is empty and has no licence; a null doc_id is kept. Equal rows are looked up each by itself. Two known
licences of one normal form count as the one of the least id. Very long texts are normalised whole. Empty tables give no rows, or no
licences. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_unique_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n©(]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|year)[^\n]*$"
RESERVED_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Spellings that count as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "centre": "center", "cancelled": "canceled", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "licence": "license", "licences": "licenses",
    "licenced": "licensed", "merchantibility": "merchantability", "noncommercial": "non  commercial", "organisation": "organization",
    "organise": "organize", "percent": "per  cent", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Whole licences and whole notices.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
}


#: What licences and their paragraphs begin with, after a statement of copyright on the same line.
OPENINGS = sorted({" ".join(re.findall(r"[a-z]+", line.lower())[:2]) for text in KNOWN.values() for line in text.split("\n") if re.match("[A-Z]", line)})
COPYRIGHT_BEFORE = COPYRIGHT_LINE.removesuffix(r"[^\n]*$") + r"[^\n]*?[^a-z0-9\n](" + "|".join(OPENINGS) + r")\b"


def normal_form(text: Column) -> Column:
    """Each word with a space before and after it."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    t = F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")), F.regexp_replace(F.regexp_replace(t, COPYRIGHT_BEFORE, "$1"), COPYRIGHT_LINE, "")).otherwise(t)
    t = F.when(F.contains(t, F.lit("all rights reserved")), F.regexp_replace(t, RESERVED_LINE, "")).otherwise(t)
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, OTHERS, "  ")), F.lit(" "))
    for word, other in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {word} "), F.lit(f" {other} "))
    return t


def known_frame(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """license_id, digest."""
    rows = spark.createDataFrame(list(known.items()), "license_id string, text string")
    return rows.select(F.sha2(normal_form(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Known digests up to this number go to every task (about a hundred bytes each); more are joined by shuffle.
BROADCAST_DIGESTS = 50_000


def looked_up(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, n_words and digest of the normal form, license_id (null: none) of every document. `known` has a row for each digest."""
    form = normal_form(F.col("text"))
    rows = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), form.alias("form"))
    words = F.when(F.length(F.trim("form")) == 0, 0).otherwise(F.size(F.split(F.trim("form"), "  "))).cast("long")
    rows = rows.select("doc_id", words.alias("n_words"), F.sha2("form", 256).alias("digest"))
    if known.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        # texts of one digest, such as empty ones, then meet nowhere
        known = F.broadcast(known)
    return rows.join(known, "digest", "left").select("doc_id", "n_words", "digest", "license_id")
