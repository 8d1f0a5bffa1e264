"""Registered queries of this folder and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers

from modspark.llm import (
    collocations,
    embedding_dedup,
    exact_dedup,
    langid,
    language_model,
    mixing,
    piece_lattice,
    prefix_trie,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)
from modspark.llm.base import table

QUERIES = {
    "op1_language_id": lambda spark, folder: langid.identify(table(spark, folder, "documents")),
    "op2_piece_lattice": lambda spark, folder: piece_lattice.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op3_simhash": lambda spark, folder: simhash.near_dedup(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id"),
    "op4_sharding": lambda spark, folder: sharding.shard(table(spark, folder, "documents")),
    "op5_token_files": lambda spark, folder: token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op6_mixing": lambda spark, folder: mixing.mix(table(spark, folder, "documents")).drop("repeats", "digest"),
    "op7_suffix_dedup": lambda spark, folder: suffix_dedup.repeats(table(spark, folder, "documents")),
    "op8_toxicity": lambda spark, folder: toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op9_embedding_dedup": lambda spark, folder: embedding_dedup.near_dedup(table(spark, folder, "embeddings")),
    "op10_exact_dedup": lambda spark, folder: exact_dedup.exact_dedup(table(spark, folder, "documents")),
    "op11_prefix_trie": lambda spark, folder: prefix_trie.trie(table(spark, folder, "conversations")),
    "op12_collocations": lambda spark, folder: collocations.collocations(table(spark, folder, "documents")),
    "op13_language_model": lambda spark, folder: language_model.score(table(spark, folder, "documents")),
}

SQL = {
    "op6_mixing": r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as draw from documents),
sources as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size) as cap,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from rows group by source),
levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following))::double as lev
  from sources),
plan as (
  select source, source_size,
    least(cap, weight * (select max(lev) from levels where lev <= cap / weight)) as target from levels),
split as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from plan)
select doc_id, size, source_size, target,
  (size * (whole + case when target - whole * source_size > 0
    and 2 * sum(size) over (partition by r.source order by draw, doc_id rows between unbounded preceding and current row) - size
      <= 2 * (target - whole * source_size) then 1 else 0 end))::bigint as taken
from rows r join split s on r.source is not distinct from s.source""",
    "op10_exact_dedup": r"""
with rows as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents)
select doc_id, min(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  doc_id = min(doc_id) over (partition by text) as kept, sha256(text) as text_sha256 from rows""",
    "op11_prefix_trie": r"""
with recursive turns as (
  select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null),
-- crc32 of the decimal id: each byte is taken in, then eight steps follow
ids as (
  select conv, conv - conv % 5 as first, xor(list_reduce(
      list_concat([4294967295::bigint], flatten([[ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(conv::varchar, '')])),
      lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, (acc & 1) * 3988292384::bigint) end), 4294967295::bigint) % 9 as h
  from (select distinct conv from turns)),
lists as (select conv, list({'role': role, 'text': text} order by place) as said from turns group by conv),
rebuilt as (
  select i.conv, list_concat(coalesce(b.said[1:h], []), coalesce(o.said[h + 1:], [])) as said
  from ids i join lists o on o.conv = i.conv left join lists b on b.conv = i.first),
prefixes as (select conv, d, said[1:d] as prefix, len(said) = d as ends from (select *, unnest(range(0, len(said) + 1)) as d from rebuilt)),
nodes as (
  select d, prefix, min(conv) as conv, count(*) as n, coalesce(string_agg(conv::varchar, ',' order by conv) filter (ends), '') as ended
  from prefixes group by d, prefix),
kids as (select p.conv, p.d, count(*) as n from nodes c join nodes p on p.d = c.d - 1 and p.prefix = c.prefix[1:c.d - 1] group by p.conv, p.d),
own as (
  select n.*, coalesce(k.n, 0) as children, (n.n - 1) * coalesce(strlen(n.prefix[n.d].text), 0) as saved
  from nodes n left join kids k on k.conv = n.conv and k.d = n.d),
below as (
  select t.conv, t.d, sum((w.children = 0)::int)::bigint as leaves, sum(w.saved)::bigint as saved
  from (select *, unnest(range(0, d + 1)) as up from own) w join own t on t.d = w.up and t.prefix = w.prefix[1:w.up] group by t.conv, t.d)
select o.conv as conv_id, o.d as depth, p.conv as parent_conv_id, o.n as n_convs, o.children as n_children,
  b.leaves as n_leaves, b.saved as saved_tokens, sha256(o.ended) as ends_sha256
from own o join below b on b.conv = o.conv and b.d = o.d left join own p on p.d = o.d - 1 and p.prefix = o.prefix[1:o.d - 1]""",
    "op12_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
runs as (
  select lang, k, w[i:i + k - 1] as words from (
    select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3]) as k from pieces))),
f as (select lang, k, words, count(*)::hugeint as n from runs group by all),
sizes as (select lang, sum(n)::bigint as n from f where k = 1 group by lang),
candidates as (select * from f where k > 1 and n >= 10),
cuts as (
  select c.lang, c.words, c.k, c.n, i, l.n as l, r.n as r, (1000000::hugeint * c.n * c.n) // (l.n * r.n) as score
  from (select *, unnest(range(1, k)) as i from candidates) c
  join f l on l.lang = c.lang and l.words = c.words[1:i] join f r on r.lang = c.lang and r.words = c.words[i + 1:]),
scored as (select * from cuts qualify row_number() over (partition by lang, words order by score, i) = 1),
longer as (
  select lang, words, max(n) as n from (
    select lang, words[1:2] as words, n from candidates where k = 3 union all select lang, words[2:3], n from candidates where k = 3) group by all),
kept as (
  select s.lang, array_to_string(s.words, ' ') as phrase, s.n as a, l, r, score
  from scored s left join longer x on s.k = 2 and x.lang = s.lang and x.words = s.words where x.n is null or 100 * x.n < 50 * s.n)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, s.n, score::bigint as score
from kept k join sizes s on s.lang = k.lang qualify rank <= 2000""",
}
