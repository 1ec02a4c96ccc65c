"""SQL twins for DuckDB of the manifest and of the conversation queries, put together from parts."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FAN, LEVELS = 16, 5  # 16 ** 5 rows of a source


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: two steps of four bits for each character."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    step = f"xor({{0}} >> 4, {table}[({{0}} & 15) + 1])"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda h, c: {step.format('(' + step.format('xor(h, c)') + ')')}), 4294967295)"


def _levels(name: str, key: str) -> str:
    """Nodes and siblings of each level above the table ``name``0 (key, pos, n, h)."""
    parts = []
    for level in range(LEVELS):
        run = f"PARTITION BY {key}, pos // {FAN} ORDER BY pos"
        parts.append(f"""{name}s{level} AS (
          SELECT {key}, pos, n,
                 CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
                 CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a
          FROM {name}{level}
        ), {name}{level + 1} AS (
          SELECT {key}, pos // {FAN} AS pos, (any_value(n) + {FAN - 1}) // {FAN} AS n,
                 CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
          FROM {name}{level} GROUP BY {key}, pos // {FAN}
        )""")
    return ", ".join(parts)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def merkle() -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = " || ".join(map(_field, [*fields, "text"]))
    changed = " || ".join(map(_field, [*fields, LOWER.format("text")]))
    key = "coalesce('1' || source, '0')"
    sides, fold, joins = [], "t", []
    for name, at, on in (("l", "d", "key"), ("t", "s", "key0")):
        for level in range(LEVELS):
            side = f"{name}s{level}"
            sides.append(f"{side}.b || {side}.a")
            fold = f"CASE WHEN {side}.n > 1 THEN sha256({side}.b || {fold} || {side}.a) ELSE {fold} END"
            joins.append(f"JOIN {side} ON {side}.{on} = {at}.{on} AND {side}.pos = {at}.pos // {FAN**level}")
        if name == "l":
            joins.append("JOIN t0 s ON s.key = d.key")
    return f"""
        WITH d AS (
          SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n
          FROM (SELECT doc_id, {key} AS key, sha256({leaf}) AS h,
                       CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS t
                FROM documents)
        ), l0 AS (
          SELECT key, pos, n, h FROM d
        ), {_levels("l", "key")}, t0 AS (
          SELECT '' AS key0, key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM l{LEVELS}
        ), {_levels("t", "key0")}, f AS (
          SELECT d.doc_id, d.h AS leaf, s.h AS subroot, t{LEVELS}.h AS root, sha256({" || ".join(sides)}) AS proof_sha256, {fold} AS folded_root
          FROM d {" ".join(joins)} CROSS JOIN t{LEVELS}
        )
        SELECT *, folded_root = root AS verified FROM f
    """


def _shielded(value: str) -> str:
    return rf"regexp_replace({value}, '<(\\*)\|', '<\\\1|', 'g')"


CHAT = f"""
        WITH c AS (
          SELECT *, false AS probe FROM conversations
          UNION ALL SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok', true FROM (VALUES (0, 'user'), (1, 'assistant')) p(turn, role)
        ), t AS (
          SELECT conv_id, probe, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id, probe ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
          FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || {_shielded("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10)
                               || {_shielded("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id, probe
    """


AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}  # place in the grammar after a role


def _least(place: int) -> str:
    """The least (cost, audit, text so far) with which a conversation stands at ``place`` after the row r, from p."""
    names, found = {"u": "user", "a": "assistant"}, []
    for start in range(4):
        at, letters, said, price = start, "", "", 0
        for _ in range(3):

            def edit(letter: str, cost: str, line: str, when: str) -> str:
                return f"CASE WHEN p.s{start} IS NOT NULL AND {when} THEN {{'c': p.s{start}.c + {price} + {cost}, 'a': p.s{start}.a || '{letters}{letter}', 'o': p.s{start}.o || {said or "''"} || {line}}} END"

            if at == place:
                found.append(edit("D", "2", "''", "true"))
            for symbol in "sua":
                if AFTER.get((at, symbol)) == place:
                    found.append(edit("K", "r.extra", "chr(10) || r.role || ':' || r.text", f"NOT r.gone AND left(r.role, 1) = '{symbol}'"))
                    if symbol in names:
                        found.append(edit("R", "1 + r.extra", f"'\n{names[symbol]}:' || r.text", "NOT r.gone"))
            symbol = next(s for s in "ua" if (at, s) in AFTER)
            at, letters, said, price = AFTER[at, symbol], letters + "I", f"{said or "''"} || '\n{names[symbol]}:'", price + 5
    return f"list_min([{', '.join(found)}])"


def _ended() -> str:
    """The least end of a repair: no insertion, or the missing answer, or a pair after a lone system message."""
    ends = ["p.s0", "p.s3"]
    for place, tail in ((1, ("user", "assistant")), (2, ("assistant",))):
        said = "".join(f"\n{name}:" for name in tail)
        ends.append(f"CASE WHEN p.s{place} IS NOT NULL THEN {{'c': p.s{place}.c + {5 * len(tail)}, 'a': p.s{place}.a || '{'I' * len(tail)}', 'o': p.s{place}.o || '{said}'}} END")
    return f"list_min([{', '.join(ends)}])"


EMPTY_STATE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
REPAIR = f"""
        WITH RECURSIVE picked AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS pick
          FROM conversations
        ), damaged AS (
          SELECT coalesce('1' || conv_id, '0') AS key, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
                 CASE pick WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
          FROM picked, LATERAL (SELECT unnest(range(CASE pick WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) c
        ), faulty AS (
          SELECT *, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body,
                 row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST) AS seen,
                 row_number() OVER turns AS place, lag(left(role, 1)) OVER turns || left(role, 1) AS pair
          FROM damaged WINDOW turns AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, text)
        ), r AS (
          SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                 fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra
          FROM faulty
        ), conv AS (
          SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS key FROM conversations
        ), p AS (
          SELECT key, 0 AS place, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {EMPTY_STATE} AS s1, {EMPTY_STATE} AS s2, {EMPTY_STATE} AS s3 FROM conv
          UNION ALL
          SELECT p.key, r.place, {", ".join(map(_least, range(4)))}
          FROM p JOIN r ON r.key = p.key AND r.place = p.place + 1
        ), ended AS (
          SELECT p.key, {_ended()} AS best FROM p SEMI JOIN (SELECT key, max(place) AS place FROM p GROUP BY key) l ON l.key = p.key AND l.place = p.place
        ), counted AS (
          SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                 count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                 count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM r GROUP BY key
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
               sha256(substr(best.o, 2)) AS repaired_sha256
        FROM conv JOIN ended USING (key) LEFT JOIN counted USING (key)
    """
