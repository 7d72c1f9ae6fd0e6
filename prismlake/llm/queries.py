"""The registered queries of the training-data operators, and their DuckDB SQL.

Each query applies its operator with production parameters to a whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.bpe import decode_documents, encode_documents

    path = tokenizer_path()
    out = decode_documents(encode_documents(read(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.bpe import encode_documents
    from prismlake.llm.packing import WINDOW, assign_sequences, cut_documents

    encoded = encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    pieces = cut_documents(encoded, WINDOW).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign_sequences(pieces, WINDOW)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm import secrets

    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select("doc_id", *(_count_kind(k) for k in kinds), F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
                        secrets.span_text(F.col("spans")).alias("spans"))


def _op6_sql() -> str:
    """The same spans by list functions.  Patterns and limits are stated on their own."""
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+))""", 6),
        "access": (r"AKIA[A-Z0-9]+", 20),
        "hex": (r"[0-9a-f]+", 24),
        "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
        "repo_token": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
        "chat_token": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    }
    start = ("(list_sum(list_transform(g[1:i], lambda x: length(x))) + "
             "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint")
    parts = []
    for order, (kind, (pattern, least)) in enumerate(kinds.items()):
        size = f"length(regexp_extract(m[i], '{pattern}', 2))" if kind == "assign" else "length(m[i])"
        parts.append(f"""{kind}_spans as (select doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: {size} >= {least}),
            lambda i: {{'s': {start}, 'o': {order}, 'k': '{kind}', 't': '{kind}:' || {start} || ':' || ({start} + length(m[i]))}}) as s
            from (select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as m,
                  string_split_regex(coalesce(text, ''), '{pattern}') as g from documents))""")
    names = list(kinds)
    joins = " ".join(f"join {k}_spans using (doc_id)" for k in names[1:])
    listed = "list_concat(" * (len(names) - 1) + f"{names[0]}_spans.s" + "".join(f", {k}_spans.s)" for k in names[1:])
    text = lambda spans: f"coalesce(array_to_string(list_transform({spans}, lambda x: x.t), ','), '')"
    return f"""with {', '.join(parts)}, joined as (select doc_id, list_sort({listed}) as s from {names[0]}_spans {joins})
        select doc_id, {', '.join(f"len(list_filter(s, lambda x: x.k = '{k}'))::bigint as n_{k}" for k in names[:3])},
               sha256({text("list_filter(s, lambda x: x.o < 3)")}) as base_sha256, {text("s")} as spans
        from joined"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.substrings import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.pii import BASE, find_pii, span_text

    found = find_pii(read(spark, sf_dir, "documents"))
    counts = [_count_kind(k) for k in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _op5_sql() -> str:
    """The same spans by list functions.  Patterns and limits are stated on their own."""
    start = ("(list_sum(list_transform(g[1:i], lambda x: length(x))) + "
             "coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint")
    around = f"substring(t, greatest({start} - 50, 0) + 1, least({start}, 50)) || ' ' || substring(t, {start} + length(m[i]) + 1, 50)"
    digits = "regexp_replace(m[i], '[^0-9]', '', 'g')"
    luhn = (f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda j: case when j % 2 = 1 then reverse({digits})[j]::int "
            f"else (reverse({digits})[j]::int * 2) // 10 + (reverse({digits})[j]::int * 2) % 10 end)) % 10 = 0)")
    plain = "replace(m[i], ' ', '')"
    mod97 = (f"(list_reduce(list_prepend(0::hugeint, list_transform(string_split({plain}[5:] || {plain}[1:4], ''), "
             "lambda c: (case when ascii(c) < 58 then ascii(c) - 48 else ascii(c) - 55 end)::hugeint)), "
             "lambda a, v: case when v < 10 then (a * 10 + v) % 97 else (a * 100 + v) % 97 end) = 1)")
    lengths = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
               22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
               26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
               30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}
    iban = r"\b(?:" + "|".join(f"(?:{codes})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in lengths.items()) + r")\b"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               "(list_max(list_transform(string_split(m[i], '.'), lambda p: p::double)) <= 255)"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"(length({digits}) between 16 and 19 and {luhn})"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"(length({digits}) between 8 and 15)"),
        "iban": (iban, mod97),
        "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", rf"regexp_matches({around}, '(?i)\b(?:ssn|social security)\b')"),
    }
    parts = []
    for kind, (pattern, ok) in kinds.items():
        parts.append(f"""{kind}_spans as (select doc_id, list_transform(list_filter(range(1, len(m) + 1), lambda i: {ok}),
            lambda i: '{kind}:' || {start} || ':' || ({start} + length(m[i]))) as s
            from (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{pattern}') as m,
                  string_split_regex(coalesce(text, ''), '{pattern}') as g from documents))""")
    names = list(kinds)
    joins = " ".join(f"join {k}_spans using (doc_id)" for k in names[1:])
    listed = lambda ks: "list_concat(" * (len(ks) - 1) + f"{ks[0]}_spans.s" + "".join(f", {k}_spans.s)" for k in ks[1:])
    return f"""with {', '.join(parts)}
        select doc_id, {', '.join(f'len({k}_spans.s)::bigint as n_{k}' for k in names[:4])},
               sha256(coalesce(array_to_string({listed(names[:4])}, ','), '')) as base_sha256,
               coalesce(array_to_string({listed(names)}, ','), '') as spans
        from {names[0]}_spans {joins}"""


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.neighbours import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_pseudolikelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.pseudolikelihood import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.quality import quality_rules

    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.langid import held_out, identify, train_on_documents

    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_on_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.prefix_trie import prefix_trie, with_end_digests

    return with_end_digests(prefix_trie(read(spark, sf_dir, "conversations")))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.structure_repair import repair_conversations, with_digests

    return with_digests(*repair_conversations(read(spark, sf_dir, "conversations")))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string: each byte is mixed in (its code + 1), then eight single-bit steps (0)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda z: [(ord(z) + 1)::bigint, 0, 0, 0, 0, 0, 0, 0, 0]))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda a, o: case when o > 0 then xor(a, o - 1) "
            "when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)")


def _op11_sql() -> str:
    """Every prefix of every rebuilt conversation as a row, and nodes joined to all their prefixes."""
    return f"""with t as (select conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''),
            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
          from conversations where conv_id is not null group by conv_id),
        h as (select conv_id, turns, {_crc32_sql("conv_id::varchar")} % 9 as h from t),
        c as (select h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
          from h left join t b on b.conv_id = h.conv_id - h.conv_id % 5),
        k as (select conv_id, turns, list_transform(range(0, len(turns) + 1), lambda d: d || ':' || md5(array_to_string(
            list_transform(turns[1:d], lambda y: md5(strlen(y.r) || ':' || y.r || y.x)), ','))) as keys from c),
        p as (select conv_id, turns, keys, unnest(range(0, len(turns) + 1)) as depth from k),
        m as (select conv_id, depth, keys[depth + 1] as node, keys[depth] as parent, keys[1:depth + 1] as path, len(turns) = depth as ended,
            case when depth > 0 then strlen(turns[depth].x) else 0 end as bytes from p),
        n as (select node, any_value(depth) as depth, any_value(parent) as parent, any_value(path) as path, min(conv_id) as conv_id, count(*) as n_convs,
            (count(*) - 1) * any_value(bytes) as saved, list(conv_id order by conv_id) filter (ended) as ends from m group by node),
        b as (select parent as node, count(*) as n_children from n where parent is not null group by parent),
        l as (select n.*, coalesce(b.n_children, 0) as n_children from n left join b on n.node = b.node),
        s as (select a as node, sum(saved) as saved_tokens, count_if(n_children = 0) as n_leaves
            from (select unnest(path) as a, saved, n_children from l) q group by a)
        select l.conv_id, l.depth::bigint as depth, u.conv_id as parent_conv_id, l.n_convs, l.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves,
            s.saved_tokens::bigint as saved_tokens, sha256(coalesce(array_to_string(l.ends, ','), '')) as ends_sha256
        from l join s on l.node = s.node left join n u on l.parent = u.node"""


def _op12_sql() -> str:
    """A fold over the damaged rows of a conversation.  A state of the role grammar holds the
    cheapest way to it as one string: cost, audit, and the repaired lines behind a separator;
    the smallest string is the smallest (cost, audit)."""
    add = lambda state, cost, letter, line: (
        f"lpad((substr({state}, 1, 6)::int + {cost})::varchar, 6, '0') || substr({state}, 7, strpos({state}, chr(1)) - 7) || '{letter}' || chr(1)"
        f" || substr({state}, strpos({state}, chr(1)) + 1)" + (f" || chr(10) || {line}" if line else ""))
    grown = lambda s: (f"{{'e': {s}.e, 's': {s}.s, 'u': least({s}.u, {add(s + '.e', 2, 'I', chr(39) + 'user:' + chr(39))}, "  # noqa: E731
                       f"{add(s + '.s', 2, 'I', chr(39) + 'user:' + chr(39))}, {add(s + '.a', 2, 'I', chr(39) + 'user:' + chr(39))}), 'a': {s}.a, "
                       "'r': 'x', 'f': '-', 'l': '', 'w': ''}")
    closed = lambda s: (f"{{'e': {s}.e, 's': {s}.s, 'u': {s}.u, 'a': least({s}.a, {add(s + '.u', 2, 'I', chr(39) + 'assistant:' + chr(39))}), "  # noqa: E731
                        "'r': 'x', 'f': '-', 'l': '', 'w': ''}")
    keep = lambda state, role: f"case when ok and y.r = '{role}' then {add(state, 'more', 'K', 'y.l')} end"
    rerole = lambda state, name: f"case when ok then {add(state, '2 + more', 'R', chr(39) + name + ':' + chr(39) + ' || y.w')} end"
    delete = lambda state: add(state, 3, "D", "")
    step = (f"{{'e': {delete('v.e')}, 's': least({delete('v.s')}, {keep('v.e', 's')}), 'u': least({delete('v.u')}, "
            + ", ".join(f"{keep('v.' + q, 'u')}, {rerole('v.' + q, 'user')}" for q in "esa")
            + f"), 'a': least({delete('v.a')}, {keep('v.u', 'a')}, {rerole('v.u', 'assistant')}), 'r': 'x', 'f': '-', 'l': '', 'w': ''}}")
    step = step.replace("ok", "(y.f not in ('b', 'd'))").replace("more", "(case when y.f = 't' then 1 else 0 end)")
    bind = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    fold = bind(step, "g", bind(grown("g"), "j", closed("j")))
    blank = "regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    start = bind("{'e': '000000' || chr(1), 's': null::varchar, 'u': null::varchar, 'a': null::varchar, 'r': 'x', 'f': '-', 'l': '', 'w': ''}", "g",
                 bind(grown("g"), "j", closed("j")))
    return f"""with d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations),
        x as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
            case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(range(case when fate = 3 then 2 else 1 end)) as copy from d where fate <> 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, {blank} as bare from x),
        f as (select *, case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
            when right(bare, 1) not in ('.', '!', '?') then 't' else '-' end as fault,
            case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'x' end as initial from o),
        p as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair from f),
        g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'b') as blank, count_if(fault = 'd') as duplicate,
            count_if(fault = 't') as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal,
            list({{'e': null::varchar, 's': null::varchar, 'u': null::varchar, 'a': null::varchar, 'r': initial, 'f': fault, 'l': role || ':' || text, 'w': text}} order by i) as ys
            from p group by conv_id),
        r as (select *, list_reduce(list_prepend({start}, ys), lambda v, y: {fold}) as z from g),
        b as (select *, least(z.e, z.a) as best from r)
        select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
            coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(substr(best, 1, 6)::bigint, 0) as cost,
            coalesce(substr(best, 7, strpos(best, chr(1)) - 7), '') as audit, sha256(coalesce(substr(best, strpos(best, chr(1)) + 2), '')) as repaired_sha256
        from (select distinct conv_id from conversations) i left join b on b.conv_id is not distinct from i.conv_id"""


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismlake.llm.bpe import encode_documents
    from prismlake.llm.pattern_packing import WINDOW, cut_documents, place_pieces

    encoded = encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    pieces = cut_documents(encoded, WINDOW).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place_pieces(pieces, WINDOW)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_pseudolikelihood": op3_pseudolikelihood,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_neighbours": op8_neighbours,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_pattern_packing": op13_pattern_packing,
}

ORACLES: dict[str, str] = {"op5_pii": _op5_sql(), "op6_secrets": _op6_sql(), "op11_prefix_trie": _op11_sql(), "op12_structure_repair": _op12_sql()}
