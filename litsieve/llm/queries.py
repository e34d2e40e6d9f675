"""The registered queries of the subpackage, each an operator over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, fertility, html_extract, jaccard_join, packing, spelling, substring_dedup, token_files, toxicity, url_filter, vector_codes
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    digests = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, capacity=2048).drop("row_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select -7L as conv_id, turn, role, '{said}' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    made = chat_format.format_conversations(rows.unionByName(more))
    turns = chat_format.parse(F.col("formatted"))
    loss = F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    said_back = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said_back.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "round_trips",
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"), least_chars=5, least_n=3, ratio=2)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fertility.judged(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_files, op3_html_extract, op4_toxicity, op5_chat_format, op6_ngram_jaccard, op7_exact_dedup, op8_url_filter, op9_substring_dedup, op10_decontaminate, op11_vector_codes, op12_spelling_variants, op13_quality_rules)}


OP5_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
pieces as (
  select *, case when contains(role, chr(10)) or contains(role || chr(10) || text, '<s>') or contains(role || chr(10) || text, '</s>')
      or contains(role || chr(10) || text, '&lt;') or contains(role || chr(10) || text, '&amp;') or contains(role, '&nl;')
    then length(replace(replace(replace(replace(role, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), chr(10), '&nl;'))
       + length(replace(replace(replace(text, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'))
    else length(role) + length(text) end + 8 as n
  from rows)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars, true as round_trips
from pieces group by conv_id
"""

OP6_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
tokens as (
  select doc_id, array_to_string(w, ' ') as t from words where len(w) in (1, 2)
  union select doc_id, array_to_string(w[i:i + 2], ' ') from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) > 2)),
sizes as (select doc_id, count(*) as n from tokens group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as i from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from both_ join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * i >= 90 * (x.n + y.n - i)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as component_id
from documents d left join sizes s on d.doc_id = s.doc_id left join reach r on d.doc_id = r.a group by d.doc_id, s.n
"""

OP7_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


def op8_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.verdict)}, {quoted(r.name)}, {quoted(r.regex)}, {str(r.site).lower()})" for r in url_filter.SITE_RULES + url_filter.WORD_RULES)
    return f"""
with rules(verdict, name, regex, site) as (values {rules}),
pages_ as (select page_id, row_number() over () as n,
    translate(coalesce(regexp_extract(url, {quoted(url_filter.HOST)}, 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
    coalesce(regexp_extract(url, {quoted(url_filter.PATH)}, 1), '') as path from pages),
fit as (select p.n, r.* from pages_ p join rules r on regexp_matches(p.host || p.path, r.regex)),
best as (select n, arg_min(name, (-length(name), name)) as rule, arg_min(verdict, (-length(name), name)) as verdict from fit where site group by n),
own as (select n, min(name) as pattern, bool_or(verdict = 'block') as blocked from fit where not site group by n)
select page_id, host, path, rule, coalesce(best.verdict, case when blocked then 'block' else 'allow' end) as verdict,
  case when best.rule is null then pattern end as pattern
from pages_ left join best using (n) left join own using (n)
"""


def op11_sql(rounds: int = 6) -> str:
    """Lloyd rounds written out as one materialised step after another."""
    near = """
a{k} as materialized (
  select vec_id, p, part, arg_min(e, (d, e)) as e, min(d) as d
  from (select m.vec_id, m.p, m.part, c.e, cast(list_sum(list_transform(list_zip(m.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
        from parts m join c{k} c on m.p = c.p) group by vec_id, p, part),"""
    means = """
s{k} as (select p, e, i, cast(sum(x) as bigint) as s, count(*) as n from (select p, e, unnest(range(1, 9)) as i, unnest(part) as x from a{k}) group by all),
m{k} as (select p, e, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as part from s{k} group by p, e),
c{n} as materialized (select c.p, c.e, coalesce(m.part, c.part) as part from c{k} c left join m{k} m on c.p = m.p and c.e = m.e),"""
    steps = "".join((near + means).format(k=k, n=k + 1) for k in range(rounds)) + near.format(k=rounds)
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
parts as materialized (select vec_id, p, v[8 * p + 1 : 8 * p + 8] as part from (select vec_id, v, unnest(range(0, 8)) as p from kept)),
c0 as materialized (
  select p, f.e, part from parts join (select vec_id, row_number() over (order by vec_id) - 1 as e from (select vec_id from kept order by vec_id limit 16)) f using (vec_id)),{steps}
found as (select vec_id, string_agg(format('{{:02x}}', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id)
select k.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(part, ','), ',' order by p, e)) from c{rounds}) as codebooks_sha256
from kept k join found f on k.vec_id = f.vec_id
"""


OP12_SQL = """
with recursive crc_table as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by b) as t
  from (select cast(unnest(range(256)) as bigint) as b)),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents),
counted as (select id, run, count(*) as times from runs where length(run) >= 5 group by all),
bytes as (
  select *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)] else [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] end)) as b from counted),
hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda y: cast(y as bigint))), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])), 4294967295) as h from bytes, crc_table),
edited as (select case when h % 97 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, times from hashed),
words as materialized (select word, cast(sum(times) as bigint) as n from edited where length(word) >= 5 group by word having sum(times) >= 3),
holes as materialized (select word, n, left(word, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select x.word, y.word as near, y.n as m from holes x join holes y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select h.word, w.word, w.n from holes h join words w on h.a || h.b = w.word
  union select w.word, h.word, h.n from holes h join words w on h.a || h.b = w.word),
best as (select word, count(*) as n_near, arg_min(near, (-m, near)) as near, max(m) as m from near group by word),
held as materialized (
  select word, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then near end as form, case when m >= 2 * n then m end as form_n from words left join best using (word)),
path(word, at_) as (select word, word from held union select p.word, h.form from path p join held h on p.at_ = h.word where h.form is not null)
select h.word, h.form, p.at_ as root, h.n, h.n_near, h.form_n
from held h join path p on h.word = p.word join held e on p.at_ = e.word where e.form is null
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": op8_sql(), "op11_vector_codes": op11_sql(), "op12_spelling_variants": OP12_SQL}
