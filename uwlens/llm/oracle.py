"""DuckDB statements of the operators that SQL can express, for the value check.

op2, op4 (classifiers), op3 (character offsets of regular expressions), op6 (sampling), op10
(similarity of all pairs) and op11 (eigenvectors) have none; tests hold them against brute force, numpy or
held-out labels.
"""

from __future__ import annotations

#: The oracle's own copy of the fixed values: licences and the normalised sentences of their rules, in order.
_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", (
        "released under the mit license",
    )),
    ("MIT", (
        "licensed under the mit license",
    )),
    ("MIT", (
        "this project is licensed under the mit license",
    )),
    ("MIT", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the software",
    )),
    ("Apache-2.0", (
        "licensed under the apache license version 2 0",
    )),
    ("Apache-2.0", (
        "licensed under the apache license version 2 0 the license",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    )),
    ("GPL-3.0", (
        "this work is licensed under the gnu general public license version 3",
    )),
    ("GPL-3.0-or-later", (
        "this program is free software",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
    )),
    ("GPL-2.0-or-later", (
        "this program is free software",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation",
        "either version 2 of the license or at your option any later version",
    )),
    ("BSD-2-Clause", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    )),
    ("BSD-3-Clause", (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    )),
    ("ISC", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    )),
    ("Unlicense", (
        "this is free and unencumbered software released into the public domain",
    )),
    ("CC-BY-4.0", (
        "this work is licensed under a creative commons attribution 4 0 international license",
    )),
    ("CC-BY-SA-4.0", (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    )),
    ("CC-BY-NC-4.0", (
        "licensed under cc by nc 4 0",
    )),
    ("CC0-1.0", (
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this "
        "work",
    )),
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    render = "'<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
final AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS cut,
                 arg_max(text, turn) FILTER (role = 'assistant') AS answer, max(turn) AS top FROM c GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, c.text FROM c JOIN final f USING (conv_id) WHERE f.cut IS NULL OR c.turn < f.cut
  UNION ALL
  SELECT f.conv_id, 'rejected', coalesce(f.cut, f.top + 1), 'assistant', p.answer
  FROM final f JOIN final p ON p.conv_id = xor(f.conv_id, 1) AND p.answer IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS place FROM sides),
pos AS (SELECT pair_id, place, count(*) AS n, count(DISTINCT role || chr(0) || text) AS kinds FROM placed GROUP BY pair_id, place),
cut AS (SELECT pair_id, coalesce(min(place) FILTER (n < 2 OR kinds > 1) - 1, max(place)) AS prompt_turns FROM pos GROUP BY pair_id),
seg AS (SELECT p.pair_id, p.side, p.place, p.role, c.prompt_turns, p.place <= c.prompt_turns AS shared, {render} AS body,
               length('<|' || role || '|>' || chr(10)) AS head FROM placed p JOIN cut c USING (pair_id)),
laid AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, side, shared ORDER BY place
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM seg)
SELECT pair_id, max(prompt_turns) AS prompt_turns,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (shared AND side = 'chosen'), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (NOT shared AND side = 'chosen'), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY place) FILTER (NOT shared AND side = 'rejected'), '') AS rejected,
       coalesce(string_agg((spot + head)::BIGINT || ':' || (spot + length(body) - 1)::BIGINT, ',' ORDER BY place)
                FILTER (NOT shared AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((spot + head)::BIGINT || ':' || (spot + length(body) - 1)::BIGINT, ',' ORDER BY place)
                FILTER (NOT shared AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM laid GROUP BY pair_id"""


def _op5() -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
ik AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM ik)),
d AS (SELECT doc_id, {words} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM ik),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, s, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _op7() -> str:
    return f"""
WITH k AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM k WINDOW g AS (PARTITION BY text_sha256)"""


def _op8() -> str:
    return r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
      FROM d GROUP BY source_key, source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + (r - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
q AS (SELECT *, row_number() OVER f AS j,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
             sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free
      FROM w WINDOW f AS (ORDER BY cap / weight, r)),
lv AS (SELECT arg_min(level, j) AS level
       FROM (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - held) / free AS level FROM q) WHERE weight * level <= cap),
t AS (SELECT source_key, source_size, least(weight * (SELECT level FROM lv), cap) AS target FROM w),
p AS (SELECT doc_id, source_key, size, row_number() OVER (PARTITION BY source_key
             ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS position FROM d),
x AS (SELECT doc_id, size, source_size, target, position, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             (('0x' || md5('17:' || source_key)[1:12])::BIGINT % 4095 + 1) / 4096.0::DOUBLE AS start FROM p JOIN t USING (source_key)),
y AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(least(floor(position * rate + start) - floor((position - 1) * rate + start), 3) AS BIGINT) END AS copies FROM x)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM y"""


def _op9() -> str:
    ids: dict[str, str] = {}
    for _, rule in _RULES:
        for sentence in rule:
            ids.setdefault(sentence, f"S{len(ids) + 1}")
    known = ", ".join(f"('{sentence}', '{i}')" for sentence, i in ids.items())
    listed = [(name, [ids[x] for x in rule]) for name, rule in _RULES]

    def holds(rule: list[str]) -> str:
        pattern = "%" + "%".join(f"|{i}|" for i in rule) + "%"
        return "(" + " OR ".join(f"{how} LIKE '{pattern}'" for how in ("line_seq", "mark_seq", "block_seq")) + ")"

    def within(short: list[str], long: list[str]) -> bool:
        at = 0
        for x in long:
            at += at < len(short) and x == short[at]
        return at == len(short) and len(long) > len(short)

    cases = ", ".join(f"CASE WHEN {' AND NOT '.join([holds(rule), *(holds(more) for _, more in listed if within(rule, more))])} THEN '{name}' END"
                      for name, rule in listed)
    sequence = "coalesce(array_to_string(list_transform({how}, lambda x: '|' || x || '|'), ''), '') AS {how}_seq"
    return rf"""
WITH m AS (SELECT row_number() OVER () AS row_no, doc_id,
                  regexp_replace(regexp_replace({_LOWER}, '[.!?;:]+([\x09-\x0D\x20]|$)', chr(1) || '\1', 'g'), '[^a-z0-9\x01\n]+', ' ', 'g') AS t
           FROM documents),
cut AS (SELECT row_no, 'line' AS how, string_split(replace(t, chr(1), chr(10)), chr(10)) AS parts FROM m
        UNION ALL SELECT row_no, 'mark', string_split(regexp_replace(t, '[ \n]+', ' ', 'g'), chr(1)) FROM m
        UNION ALL SELECT row_no, 'block', string_split(regexp_replace(regexp_replace(t, '\n([ \x01]*\n)+', chr(1), 'g'), '[ \n]+', ' ', 'g'), chr(1)) FROM m),
known(sentence, id) AS (VALUES {known}),
s AS (SELECT row_no, how, trim(unnest(parts)) AS sentence, generate_subscripts(parts, 1) AS spot FROM cut),
seq AS (SELECT row_no, how, coalesce(list(id ORDER BY spot) FILTER (id IS NOT NULL), []) AS ids, count(*) FILTER (sentence <> '') AS n
        FROM s LEFT JOIN known USING (sentence) GROUP BY row_no, how),
wide AS (SELECT row_no, max(n) FILTER (how = 'line') AS n, any_value(ids) FILTER (how = 'line') AS line,
                any_value(ids) FILTER (how = 'mark') AS mark, any_value(ids) FILTER (how = 'block') AS block FROM seq GROUP BY row_no),
best AS (SELECT row_no, n, CASE greatest(len(line), len(mark), len(block)) WHEN len(line) THEN line WHEN len(mark) THEN mark ELSE block END AS ids,
                {sequence.format(how="line")}, {sequence.format(how="mark")}, {sequence.format(how="block")} FROM wide)
SELECT doc_id, n AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM m JOIN best USING (row_no)"""


def _op12() -> str:
    return """
WITH v AS (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS score
      FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE place <= 5"""


def _op13() -> str:
    return r"""
WITH RECURSIVE
steps(n, c, k) AS (SELECT range, CAST(range AS BIGINT), 0 FROM range(256)
                   UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT n, c FROM steps WHERE k = 8),
sums(doc_id, digits, i, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s.doc_id, s.digits, s.i + 1, xor(b.c, s.c >> 8) FROM sums s JOIN bytes b ON b.n = xor(s.c, CAST(ascii(s.digits[s.i + 1]) AS BIGINT)) & 255
  WHERE s.i < len(s.digits)),
checked AS (SELECT doc_id, xor(c, 4294967295) AS h FROM sums WHERE i = len(digits)),
d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
loops AS (SELECT row_no, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, h // 10 AS g FROM d LEFT JOIN checked USING (doc_id)),
bounds AS (SELECT *, CASE WHEN looped THEN g % n END AS a, CASE WHEN looped THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM loops),
flat AS (SELECT row_no, n, unnest(range(n)) AS i, w, a, p FROM bounds),
words AS (SELECT row_no, n, i, w[1 + CASE WHEN i < a THEN i WHEN a IS NULL THEN i ELSE a + (i - a) % p END] AS word FROM flat),
pairs AS (SELECT x.row_no, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.row_no = y.row_no AND x.word = y.word
          AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT row_no, q, min(i) AS start, count(*) + q AS length
              FROM (SELECT *, i - row_number() OVER (PARTITION BY row_no, q ORDER BY i) AS island FROM pairs)
              GROUP BY row_no, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT row_no, start, length, min(q) AS period FROM stretches GROUP BY row_no, start, length),
best AS (SELECT row_no, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'p': period}, [-length, start, period]) AS top,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row_no),
gone AS (SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row_no, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (row_no, i) GROUP BY row_no)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(top.p AS BIGINT) AS period,
       CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (row_no) LEFT JOIN kept USING (row_no)"""


def all_sql() -> dict[str, str]:
    return {"op1_preference_format": _op1(), "op5_decontamination": _op5(), "op7_exact_dedup": _op7(),
            "op8_source_mix": _op8(), "op9_license_rules": _op9(), "op12_top_products": _op12(),
            "op13_periodic_runs": _op13()}
