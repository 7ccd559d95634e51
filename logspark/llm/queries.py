"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, licenses, prefixes, quality, secrets, simhash, sstable, substrings
from .common import materialize, new_path, read_table, text_or_empty


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    read = chat.read_chat(chat.format_chat(rows.unionByName(extra)))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _op1_sql() -> str:
    t = chat.DEFAULT
    escaped = {"text": "text", "role": "role"}
    for c in t.controls():
        for k, v in escaped.items():
            first, rest = c[0], "".join("\\" + x if not x.isalnum() else x for x in c[1:])
            escaped[k] = f"regexp_replace({v}, '\\{first}(\\\\*){rest}', '{first}\\\\\\1{c[1:]}', 'g')"
    head, more = len(t.header) + len(t.header_end), len(t.more)
    return f"""
    with rows as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    marked as (
      select *, row_number() over w as k, lag(role) over w as before, lead(role) over w as after,
        length({escaped['text']}) as text_len, length({escaped['role']}) as role_len
      from rows window w as (partition by conv_id order by turn nulls first, role, text))
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
      cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
      cast(sum(text_len + case when before is distinct from role or k = 1 then {head} + role_len else {more} end
        + case when after is distinct from role then {len(t.end)} else 0 end) as bigint) as formatted_chars
    from marked group by conv_id"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_in_component")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


#: The exact similarity of all aligned windows; so it also shows that the fingerprints' radius loses none.
OP4_SQL = r"""
    with item_words as (
      select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
    items as (
      select item_id, len(w) as n, least(len(w), 5) as k,
        [array_to_string(w[i:i + least(len(w), 5) - 1], ' ') for i in range(1, len(w) - least(len(w), 5) + 2)] as s
      from item_words where len(w) > 0),
    docs as (
      select row_number() over () as r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
      from documents),
    shingles as (
      select r, k, unnest(range(0, len(w) - k + 1)) as p, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as s
      from docs, (select distinct k from items) where len(w) >= k),
    item_shingles as (select item_id, n, k, unnest(s) as s, unnest(range(0, len(s))) as o from items),
    windows as (select distinct r, item_id, i.n, i.k, s.p - i.o as start from shingles s join item_shingles i on s.k = i.k and s.s = i.s),
    inside as (
      select w.r, w.item_id, w.start, s.s, count(*) as c from windows w join shingles s
        on s.r = w.r and s.k = w.k and s.p between greatest(w.start, 0) and w.start + w.n - w.k group by all),
    sizes as (select r, item_id, start, sum(c) as m from inside group by all),
    wanted as (select item_id, s, count(*) as c from item_shingles group by all),
    item_sizes as (select item_id, sum(c) as m from wanted group by all),
    common as (select r, item_id, start, sum(least(i.c, w.c)) as c from inside i join wanted w using (item_id, s) group by all),
    alike as (
      select r, item_id, max(c * 1.0::double / (s.m + i.m - c)) as similarity
      from common join sizes s using (r, item_id, start) join item_sizes i using (item_id)
      group by all having max(c * 1.0::double / (s.m + i.m - c)) >= 0.8),
    by_doc as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by item_id) as items, max(similarity) as similarity from alike group by r)
    select doc_id, by_doc.r is not null as contaminated, coalesce(n_items, 0) as n_items, coalesce(items, '') as items,
      coalesce(similarity, 0.0::double) as similarity
    from docs left join by_doc using (r)"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    coded = bpe.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return bpe.digests(coded)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.compare_with_next(read_table(spark, sf_dir, "documents"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, read_table(spark, sf_dir, "labels")).drop("text")


def op9_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_path(spark, "sstable")
    shards, _ = materialize(sstable.write_shards(docs, vocabulary("word_bpe_49k.json"), folder), "shards")
    return sstable.read_shards(shards, folder)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op10_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, licenses.bigrams(licenses.plain_words(t))))}])" for i, (n, t) in enumerate(licenses.TEMPLATES))
    t = licenses.SIMILARITY
    most = 2 + int(max(len(licenses.bigrams(licenses.plain_words(x))) for _, x in licenses.TEMPLATES) * (2 - t) / t)
    return rf"""
    with templates(id, license, grams) as (values {rows}),
    docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    lines as (select r, string_split(text, chr(10)) as ls from docs),
    whole as (select r, text from docs union all select r, replace(text, chr(10), ' ') from docs),
    segments as (
      select r, unnest(ls) as x from lines
      union select r, unnest([ls[i] || ' ' || ls[i + 1] for i in range(1, len(ls))]) from lines
      union select r, unnest([ls[i] || ' ' || ls[i + 1] || ' ' || ls[i + 2] for i in range(1, len(ls) - 1)]) from lines
      union select r, unnest(string_split(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10))) from whole
      union select r, unnest(string_split_regex(text, '\n[^\pL\pN\n]*\n')) from docs
      union select r, text from docs),
    words as (select r, list_filter(string_split(trim(regexp_replace(lower(x), '[^\pL\pN]+', ' ', 'g')), ' '), lambda y: y <> '') as w from segments),
    grams as (
      select row_number() over () as g, r, case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end as s
      from words where len(w) between 1 and {most}),
    counted as (select g, s, count(*) as c from (select g, unnest(s) as s from grams) group by all),
    wanted as (select id, s, count(*) as c from (select id, unnest(grams) as s from templates) group by all),
    common as (select g, id, sum(least(a.c, b.c)) as c from counted a join wanted b using (s) group by all),
    alike as (
      select g, r, license, max(2 * c::double / (len(grams.s) + len(templates.grams))) as dice
      from common join grams using (g) join templates using (id) group by all
      having max(2 * c::double / (len(grams.s) + len(templates.grams))) >= {t}),
    firsts as (select r, license, dice from alike qualify row_number() over (partition by g order by dice desc, license) = 1),
    scored as (select r, license, max(dice) as dice from firsts group by all)
    select doc_id, coalesce(string_agg(license, ',' order by license), '') as licenses, count(license) as n_licenses,
      coalesce(first(license order by dice desc, license), '') as best, coalesce(max(dice), 0.0::double) as dice
    from docs left join scored using (r) group by r, doc_id"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_simhash_near_dedup, op3_substring_dedup, op4_decontaminate, op5_byte_bpe, op6_secret_scan, op7_prefix_fingerprint, op8_quality_bayes, op9_token_sstable, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _op1_sql(), "op4_decontaminate": OP4_SQL, "op10_license_scan": _op10_sql()}
