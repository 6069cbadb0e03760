"""DuckDB twins of the registered queries (independent SQL over the same tables).

DuckDB's regex engine is RE2: no lookbehind, no possessive quantifiers, and
``\\s`` is ASCII only, so whitespace is spelled out as ``W`` / ``N`` below.
Its string literals keep backslashes, and ``\\n`` is written ``chr(10)``.
"""

from __future__ import annotations

# Whitespace as Python sees it, and its complement, in RE2 syntax.
W = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
N = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
TOK = r"[<>]|[\p{L}\p{M}\p{N}]+(?:[-''’][\p{L}\p{M}\p{N}]+)*"  # '' is a quote inside SQL

SENTENCES_CTE = r"""
raw AS (
  SELECT doc_id, unnest(range(len(k))) AS pos, unnest(k) AS s FROM (
    SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS k FROM documents))
, keyed AS (
  SELECT doc_id*100000+pos AS idx, doc_id AS news_id, trim(s) AS s,
         substr(md5(concat(cast(doc_id*100000+pos AS varchar(20)),':d')),1,1) AS d
  FROM raw WHERE trim(s) <> '')
, sent AS (
  SELECT k.idx AS "index", k.news_id,
    CASE d WHEN '0' THEN concat(s,' TNR')
           WHEN '1' THEN concat('Ţara şi ţările ',s)
           WHEN '2' THEN concat(s,' www.cautatoriidepovesti.ro')
           WHEN '3' THEN concat(s,' cont.nou@exemplu.ro  acum')
           WHEN '4' THEN concat('Google <PERSON> ',s)
           WHEN '5' THEN concat(s,' la <GPE> şi <NORP>')
           WHEN '6' THEN concat(s,' https://exemplu.ro/a?b=1')
           ELSE s END AS sentence,
    CASE WHEN substr(md5(concat(cast(news_id AS varchar(20)),':m')),1,1) < '6' THEN 'life-death'
         WHEN substr(md5(concat(cast(news_id AS varchar(20)),':m')),1,1) < 'b' THEN 'it-stiinta'
         ELSE 'cronica-de-film' END AS domain,
    CASE WHEN substr(md5(concat(cast(idx AS varchar(20)),':0')),1,1) < '3' THEN 1-coalesce(l.quality,0) ELSE coalesce(l.quality,0) END AS label_0,
    CASE WHEN substr(md5(concat(cast(idx AS varchar(20)),':1')),1,1) < '3' THEN 1-coalesce(l.quality,0) ELSE coalesce(l.quality,0) END AS label_1,
    CASE WHEN substr(md5(concat(cast(idx AS varchar(20)),':2')),1,1) < '3' THEN 1-coalesce(l.quality,0) ELSE coalesce(l.quality,0) END AS label_2,
    CASE WHEN substr(md5(concat(cast(news_id AS varchar(20)),':s')),1,1) < 'a' THEN 'train'
         WHEN substr(md5(concat(cast(news_id AS varchar(20)),':s')),1,1) < 'c' THEN 'validation'
         ELSE 'test' END AS split
  FROM keyed k LEFT JOIN labels l ON k.news_id = l.doc_id)
, sentl AS (
  SELECT *, CASE WHEN label_0 + label_1 + label_2 >= 2 THEN 1 ELSE 0 END AS label FROM sent)
"""


def outputs_cte(runs: int = 1, src: str = "sentl", where: str = "split = 'test'") -> str:
    """outp(run, index, output): the fixture's raw answers for runs 1..runs."""
    return rf"""
, runs AS (SELECT CAST(r AS INTEGER) AS run FROM range(1, {runs + 1}) t(r))
, outp AS (
  SELECT run, s."index",
    CASE substr(md5(concat(CAST(run AS VARCHAR), ':', CAST(s."index" AS VARCHAR))),1,1)
      WHEN '0' THEN ''                       WHEN '1' THEN 'RĂSPUNS: satiră'
      WHEN '2' THEN 'răspuns: Factual'||chr(10)||'Explicație: nu'
      WHEN '3' THEN 'RASPUNS: factual'       WHEN '4' THEN 'Cred că este Satiră.'
      WHEN '5' THEN 'nu știu:'               WHEN '6' THEN 'RĂSPUNS: sati-ră'
      WHEN '7' THEN 'RĂSPUNS: factual sau satiră'
      ELSE 'RĂSPUNS: factual' END AS output
  FROM {src} s, runs WHERE {where})
"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def parsed_cte(src: str = "outp") -> str:
    """pr(run, index, output, c0, c1, ans, prediction): chat parsing with per-row class order."""
    marker = "strpos(upper(output), 'RĂSPUNS:')"
    seg = f"split_part(split_part(substr(output, {marker} + 8), ':', 1), chr(10), 1)"
    return rf"""
, ord AS (
  SELECT *, substr(md5(concat('order:', CAST(run AS VARCHAR), ':', CAST("index" AS VARCHAR))),1,1) >= '8' AS swapped
  FROM {src})
, ans AS (
  SELECT *, CASE WHEN swapped THEN 'satiră' ELSE 'factual' END AS c0,
            CASE WHEN swapped THEN 'factual' ELSE 'satiră' END AS c1,
            lower(CASE WHEN {marker} > 0 THEN {strip_sql(seg)}
                       WHEN suffix(output, ':') THEN ''
                       ELSE {strip_sql('output')} END) AS ans
  FROM ord)
, pick AS (
  SELECT *, regexp_replace(
      CASE WHEN contains(ans, c0) THEN c0 WHEN contains(ans, c1) THEN c1
           WHEN ans = '' THEN '-1'
           ELSE regexp_extract(ans, '^{W}*({N}*)', 1) END, '[^\p{{L}}]', '', 'g') AS letters
  FROM ans)
, pr AS (
  SELECT *, CAST(CASE WHEN contains(letters, 'factual') THEN 0
                      WHEN contains(letters, 'satiră') THEN 1 ELSE -1 END AS INTEGER) AS prediction
  FROM pick)
"""


def weighted_sql(src: str, keys: list[str], gt: str = "label", pred: str = "prediction", with_invalid: bool = True) -> str:
    """SELECT of support-weighted precision / recall / F1 per key group of ``src``."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    using = f"USING ({k})" if keys else "ON TRUE"
    inv = ", CAST(sum(CASE WHEN c = -1 THEN pp ELSE 0 END) AS BIGINT) AS n_invalid" if with_invalid else ""
    return f"""
, cls AS (SELECT DISTINCT {kk}{gt} AS c FROM {src} UNION SELECT DISTINCT {kk}coalesce({pred}, -1) FROM {src})
, pc AS (
  SELECT {', '.join('cls.' + x for x in keys) + ', ' if keys else ''}cls.c,
         sum(CASE WHEN s.{gt} = cls.c AND coalesce(s.{pred}, -1) = cls.c THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN coalesce(s.{pred}, -1) = cls.c THEN 1 ELSE 0 END) AS pp,
         sum(CASE WHEN s.{gt} = cls.c THEN 1 ELSE 0 END) AS sup
  FROM cls JOIN {src} s {using}
  GROUP BY {kk}cls.c)
SELECT {kk}CAST(sum(sup) AS BIGINT) AS n,
  round(sum(tp) / sum(sup), 6) AS accuracy,
  round(sum(sup * CASE WHEN pp = 0 THEN 0 ELSE tp / pp END) / sum(sup), 6) AS precision,
  round(sum(sup * CASE WHEN sup = 0 THEN 0 ELSE tp / sup END) / sum(sup), 6) AS recall,
  round(sum(sup * CASE WHEN pp + sup = 0 THEN 0 ELSE 2 * tp / (pp + sup) END) / sum(sup), 6) AS f1{inv}
FROM pc {('GROUP BY ' + k) if keys else ''}
"""


def with_sentences(*ctes: str) -> str:
    return "WITH " + SENTENCES_CTE + "".join(ctes)


def values_sql(rows: list[tuple], cols: str) -> str:
    """Inline VALUES for a small fixture dictionary."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) t({cols})"


EMAIL = f"{N}*@{N}*{W}?"


def norm_sql(x: str) -> str:
    """T7 -> T8 -> T9 -> T10."""
    return (f"lower(translate(regexp_replace(regexp_replace({x}, '{EMAIL}', '', 'g'), '{W}+', ' ', 'g'), "
            f"'ţş', 'țș'))")


def toks_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOK}')"


def short_sql(x: str) -> str:
    """T12 on a token list."""
    return f"list_filter({x}, lambda t: length(t) > 3 OR t IN ('<', '>'))"


def brands_sql(x: str) -> str:
    from quillspark.constants import BRANDS
    for b in BRANDS:
        x = f"replace({x}, '{b}', '<ORG>')"
    return x


def sites_sql(x: str) -> str:
    x = f"regexp_replace({x}, 'Timesnewroman.ro', '@URL', 'g')"
    return f"regexp_replace({x}, 'www.cautatoriidepovesti.ro', '@URL', 'g')"


def restore_sql(x: str, labels=("PERSON", "NORP", "GPE", "ORG", "LOC", "FAC")) -> str:
    x = f"replace({x}, '< >', '')"
    for tag in labels:
        x = f"replace({x}, '< {tag.lower()} >', '<{tag}>')"
    return x


def stop_ctes(stopwords: list[tuple], lemmas: list[tuple], lang: str = "ro") -> str:
    return f"""
, stop AS (SELECT DISTINCT regexp_replace(translate(word, 'ţş', 'țș'), '^{W}+|{W}+$', '', 'g') AS word
           FROM {values_sql(stopwords, 'lang, word')} WHERE lang = '{lang}')
, lem AS (SELECT surface, min(lemma) AS lemma FROM {values_sql(lemmas, 'lang, surface, lemma')}
          WHERE lang = '{lang}' GROUP BY surface)
"""


def process_ctes(src: str, text: str, out: str, use_dicts: bool = True) -> str:
    """T18 over ``src`` ("index", {text}) into ``out``("index", t)."""
    kept_where = ("WHERE tok NOT IN (SELECT word FROM stop) AND lemma NOT IN (SELECT word FROM stop)"
                  if use_dicts else "")
    lemma = "coalesce(lem.lemma, tu.tok)" if use_dicts else "tu.tok"
    lem_join = "LEFT JOIN lem ON lem.surface = tu.tok" if use_dicts else ""
    return f"""
, {out}_tk AS (SELECT "index", {short_sql(toks_sql(norm_sql(text)))} AS toks FROM {src})
, {out}_tu AS (SELECT "index", unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM {out}_tk)
, {out}_tl AS (SELECT tu."index", tu.pos, tu.tok, {lemma} AS lemma FROM {out}_tu tu {lem_join})
, {out}_kept AS (SELECT "index", pos, lower(lemma) AS v FROM {out}_tl {kept_where})
, {out} AS (SELECT k."index", {restore_sql("coalesce(string_agg(v, ' ' ORDER BY pos), '')")} AS t
            FROM {out}_tk k LEFT JOIN {out}_kept USING ("index") GROUP BY k."index")
"""


def gazetteer_ctes(src: str, text: str, gazetteer: list[tuple], max_n: int, out: str = "ents") -> str:
    """Entity spans per row: ``out``("index", spans list<struct(s,e,l)>) for rows with a match."""
    ngram_selects = [f'SELECT "index", e - length(tok) AS s, e, tok AS surface FROM gz_tp']
    for n in range(2, max_n + 1):
        surf = " || ".join(["tok"] + [f"lead(sep || tok, {k}) OVER w" for k in range(1, n)])
        ngram_selects.append(
            f'SELECT "index", e - length(tok) AS s, lead(e, {n - 1}) OVER w AS e, {surf} AS surface FROM gz_tp '
            f'WINDOW w AS (PARTITION BY "index" ORDER BY i)')
    ngrams = "\n  UNION ALL ".join(ngram_selects)
    return f"""
, gaz AS (SELECT surface, min(label) AS label FROM {values_sql(gazetteer, 'surface, label')} GROUP BY surface)
, gz_tk AS (SELECT "index", {toks_sql(text)} AS toks, string_split_regex({text}, '{TOK}') AS seps FROM {src})
, gz_tu AS (SELECT "index", toks, seps, unnest(range(1, len(toks) + 1)) AS i FROM gz_tk)
, gz_tp AS (SELECT "index", i, toks[i] AS tok, seps[i] AS sep,
                   sum(length(seps[i]) + length(toks[i])) OVER (PARTITION BY "index" ORDER BY i) AS e FROM gz_tu)
, gz_ng AS ({ngrams})
, gz_hit AS (SELECT g."index", CAST(g.s AS INTEGER) AS s, CAST(g.e AS INTEGER) AS e, z.label AS l
             FROM gz_ng g JOIN gaz z ON z.surface = g.surface WHERE g.surface IS NOT NULL)
, {out} AS (
  SELECT "index", list_reduce(list_sort(list({{'s': s, 'nl': s - e, 'e': e, 'l': l}})),
      lambda acc, c: CASE WHEN c.s >= acc.last
                          THEN {{'last': c.e, 'ch': list_append(acc.ch, {{'s': c.s, 'e': c.e, 'l': c.l}})}}
                          ELSE acc END,
      {{'last': 0, 'ch': []::STRUCT(s INTEGER, e INTEGER, l VARCHAR)[]}}).ch AS spans
  FROM gz_hit GROUP BY "index")
"""


def mask_sql(text: str, spans: str, labels=("PERSON", "NORP", "GPE", "ORG", "LOC", "FAC")) -> str:
    """Replace the listed-label spans of ``text`` by <LABEL>."""
    lab = ", ".join(f"'{x}'" for x in labels)
    keep = f"list_filter(coalesce({spans}, []::STRUCT(s INTEGER, e INTEGER, l VARCHAR)[]), lambda z: z.l IN ({lab}))"
    red = (f"list_reduce({keep}, lambda acc, z: {{'p': z.e, 'o': acc.o || substr({text}, acc.p + 1, z.s - acc.p) || '<' || z.l || '>'}}, "
           f"{{'p': 0, 'o': ''}})")
    return f"({red}).o || substr({text}, ({red}).p + 1)"
