"""Known licences by the digest of their canonical text.

An entire text is brought to a canonical form (case, copyright lines,
equivalent spellings, punctuation, white space) and hashed; the digest is
joined with the digests of known licence texts, made in the same way. All of
it is built-in SQL functions. ``digest`` is of ``canonical``, which serves Spark
and DuckDB alike; the licence is looked up by ``stripped``, which also drops an
optional title, list marks and copyright lines of any form. The SQL for checks
is as it was: it knows the short texts only, and by ``canonical``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- Fixed values: spellings that licence texts use for the same word --------
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"),
    ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("sublicense", "sub license"), ("https", "http"),
)
# --- End of fixed values -----------------------------------------------------

_WARRANTY = """{} PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute{} copies of the Software, and to permit persons to whom the Software is furnished to do so{}
""" + _WARRANTY.format("THE SOFTWARE IS")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n" + _ISC_WARRANTY

# Short texts, by SPDX identifier.
_SHORT = {
    "MIT": _MIT.format(", sublicense, and/or sell", """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    "MIT-0": _MIT.format(", sublicense, and/or sell", "."),
    "ISC": _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD": _ISC.format(""),
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format("""
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""" + _WARRANTY.format("THE SOFTWARE IS").replace("OR COPYRIGHT HOLDERS ", "") + "\nFor more information, please refer to <https://unlicense.org>",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
}
# Only in the SQL for checks: single lines are no licence texts.
_SQL_LINES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}


def canonical(text: str, duck: bool = False) -> str:
    """SQL of the canonical form of the text that an SQL expression gives."""
    sql = f"lower({text})"
    # A copyright line names who and when, not what is allowed.
    for pattern, by in ((r"(?m)^[^a-z0-9\n]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by )|\(c\)|©)[^\n]*$", " "), (r"(?m)^[^a-z0-9\n]*all rights reserved[^\n]*$", " "),
                        (r"&", " and "), (r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " "), (r"[\n“”„‘’«»–—©®™\x{A0}]+", " "), (r" +", " ")):
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')" if duck else f"regexp_replace({sql}, r'{pattern}', '{by}')"
    for a, b in SPELLINGS:
        sql = f"replace({sql}, '{a}', '{b}')"
    return f"nullif(trim({sql}), '')"


# Words after "copyright" at a line's start that belong to a wrapped sentence.
_SENTENCE = """notices?|holders?|owners?|laws?|licen[cs]es?|and|or|in|on|of|is|as|interests?|rights?|treaty|treaties|statements?|protection|disclaimer|
 permission|to|that|which|are|under|for|if|from|with|act|infringement|claims?|status|material|notwithstanding|you|therein|resulting|does|can|may|will""".replace("\n", "").replace(" ", "")
# A title is a line of these words alone.
_TITLE = """the|a|an|mit|mit-0|expat|x11|isc|zlib|libpng|bsd|0bsd|[0-9](-clause)?|clause|two|three|new|revised|modified|simplified|free|zero|no|attribution|
 unlicense|licen[cs]e|software|permissive|or|style""".replace("\n", "").replace(" ", "")
_STRIP = (
    (r"\r\n?", "\\n"),
    (r"(?m)^[^a-z0-9\n]*(?:\(c\)[ \t]*(?:[0-9]{4}|copyright)|©|copyright(?:ed)?[ \t]*:?(?=[ \t]+[^ \t\n])(?![ \t]+(?:%s)\b))[^\n]*$" % _SENTENCE, ""),
    (r"(?m)^[^a-z0-9\n]*all rights reserved[^\n]*$", ""),
    (r"\A[^a-z0-9]*+(?:(?:(?:%s)\b[^a-z0-9\n]*+){1,12}\n[^a-z0-9]*+){1,3}" % _TITLE, ""),
    (r"(?m)^[^a-z0-9\n]*(?:[0-9]{1,2}[.)]|[a-z]\)|[ivx]{1,5}\))[ \t]+", ""),
)


def _texts() -> dict[str, str]:
    """Known texts by SPDX identifier; what follows a # in a name is a variant."""
    out = dict(_SHORT)
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        out[path.stem] = text = path.read_text("utf-8")
        end = text.upper().find("END OF TERMS AND CONDITIONS")
        if end > 0:  # often left out: what follows the terms
            out[f"{path.stem}#terms"] = text[:end]
            out[f"{path.stem}#terms-end"] = text[:end + len("END OF TERMS AND CONDITIONS")]
    return out


KNOWN = _texts()
ONE_OF = ("warrant", "gnu")  # each known text has one of these, and the changes of form make none


def stripped(text: str) -> str:
    """SQL (Spark's) of the form that licences are looked up by: the canonical
    text without a title line, list marks and copyright lines."""
    sql = f"lower({text})"
    for pattern, by in _STRIP:
        sql = f"regexp_replace({sql}, r'{pattern}', '{by}')"
    return canonical(sql)


def known(spark: SparkSession) -> DataFrame:
    """(license_id, license_digest) of the texts above."""
    rows = spark.createDataFrame([(k.split("#")[0], t) for k, t in sorted(KNOWN.items())], "license_id string, text string")
    return rows.select("license_id", F.sha2(F.expr(stripped("text")), 256).alias("license_digest"))


def scan(docs: DataFrame, licences: DataFrame, one_of: tuple[str, ...] = ("",)) -> DataFrame:
    """(doc_id, digest, license_id) for each row of ``docs``.

    ``digest`` is the SHA-256 of the canonical text, null for a null text and
    for one of which nothing is left; ``license_id`` is null where the text,
    without title, list marks and copyright lines, is not known. ``licences``
    is (license_id, license_digest); of equal digests the first id by name
    counts. Repeated rows are looked up alike, extra columns are ignored, an
    empty table gives an empty result. The known digests are few, and the
    planner broadcasts them if their measured size allows it; a hot digest then
    meets them in place. Texts with none of ``one_of``, letters of which each
    known text has some, cannot match and are not brought to the form.
    """
    # The other texts keep their digest as key, so that they spread over the tasks.
    first = licences.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    text = "CAST(text AS STRING)"
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.expr(canonical(text)), 256).alias("digest"),
                         F.when(reduce(or_, (F.contains(F.lower(F.expr(text)), F.lit(x)) for x in one_of)), F.sha2(F.expr(stripped(text)), 256)).alias("form"))
    picked = picked.withColumn("form", F.coalesce("form", "digest"))
    return picked.join(first, picked["form"] == first["license_digest"], "left").select("doc_id", "digest", "license_id")


def oracle(texts: str = "documents") -> str:
    """In DuckDB's SQL, with the short texts and lines, looked up by ``digest``."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((_SHORT | _SQL_LINES).items()))
    return f"""WITH known AS (SELECT min(license_id) AS license_id, license_digest FROM (SELECT license_id,
 sha256({canonical('text', duck=True)}) AS license_digest FROM (VALUES {values}) t(license_id, text)) GROUP BY license_digest),
 docs AS (SELECT doc_id, sha256({canonical('text', duck=True)}) AS digest FROM {texts})
SELECT doc_id, digest, license_id FROM docs LEFT JOIN known ON digest = license_digest"""
