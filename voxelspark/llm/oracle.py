"""DuckDB SQL of text operators that SQL can express, by query."""

from __future__ import annotations

#: The unsigned crc32 of an ASCII text, bit by bit.
CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}, ''), lambda c: ascii(c)::bigint)),
  lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, (b & 1) * 3988292384::bigint))))"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


_HASHED = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEXT = "list_transform(range(0, (len(a) + 15) // 16), lambda k: sha256(array_to_string(a[k * 16 + 1 : k * 16 + 16], '')))"

MERKLE = f"""with recursive d as (select doc_id, source, sha256({_HASHED} || {_field('text')}) leaf,
  sha256({_HASHED} || {_field(_FOLDED)}) folded,
  {CRC.format(x='doc_id::varchar')} % 5 = 0 changed from documents),
leaves as (select *, row_number() over (partition by source order by doc_id) - 1 i from d),
up as (select source, 0 l, list(leaf order by doc_id) a from d group by source
  union all select source, l + 1, {_NEXT} from up where len(a) > 1),
tops as (select source, a[1] subroot, row_number() over (order by source nulls first) - 1 j from up where len(a) = 1),
over as (select 0 l, list(subroot order by j) a from tops union all
  select l + 1, {_NEXT} from over where len(a) > 1),
steps as (select doc_id, l, i // power(16, l)::bigint k, a from leaves join up on leaves.source is not distinct from up.source where len(a) > 1
  union all select doc_id, 100 + l, j // power(16, l)::bigint, a from leaves join tops on leaves.source is not distinct from tops.source, over where len(a) > 1),
sib as (select doc_id, row_number() over (partition by doc_id order by l) s, array_to_string(a[k // 16 * 16 + 1 : k], '') lo, array_to_string(a[k + 2 : k // 16 * 16 + 16], '') hi from steps),
walk as (select doc_id, 0::bigint s, case when changed then folded else leaf end h from d
  union all select w.doc_id, w.s + 1, sha256(sib.lo || w.h || sib.hi) from walk w join sib on sib.doc_id = w.doc_id and sib.s = w.s + 1),
proof as (select doc_id, sha256(string_agg(lo || hi, '' order by s)) p from sib group by doc_id)
select doc_id, leaf, subroot, o.a[1] root, coalesce(p, sha256('')) proof_sha256, h folded_root, h = o.a[1] verified
from leaves join tops on leaves.source is not distinct from tops.source join (select a from over where len(a) = 1) o on true
join (select doc_id, arg_max(h, s) h from walk group by doc_id) using (doc_id) left join proof using (doc_id)"""

TRIE = f"""with conv as (select conv_id c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, role, text) a, {CRC.format(x='conv_id::varchar')} % 6 h
  from conversations where conv_id is not null group by conv_id),
path as (select x.c, list_concat(coalesce(b.a[1 : x.h], []), x.a[x.h + 1 :]) p from conv x left join conv b on b.c = x.c - x.c % 100),
pre as (select c, len(p) own, d, sha256(to_json(p[1 : d])::varchar) k, case when d > 0 then sha256(to_json(p[1 : d - 1])::varchar) end up, case when d > 0 then length(p[d].t) else 0 end chars
  from (select *, unnest(range(0, len(p) + 1)) d from path)),
node as (select k, any_value(up) up, any_value(d) d, min(c) conv_id, count(*) n, (count(*) - 1) * any_value(chars) saved, coalesce(string_agg(c, ',' order by c) filter (own = d), '') ends from pre group by k),
kids as (select up k, count(*) n from node where up is not null group by up),
under as (select distinct a.k top, b.k from pre a join pre b on a.c = b.c and a.d <= b.d),
sums as (select top k, count(*) filter (kids.n is null) leaves, sum(node.saved) saved from under join node on node.k = under.k left join kids on kids.k = under.k group by top)
select node.conv_id::bigint conv_id, node.d::bigint depth, par.conv_id::bigint parent_conv_id, node.n::bigint n_convs, coalesce(kids.n, 0)::bigint n_children,
  sums.leaves::bigint n_leaves, sums.saved::bigint saved_tokens, sha256(node.ends) ends_sha256
from node join sums using (k) left join kids using (k) left join node par on par.k = node.up"""
