"""DuckDB SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

from marketreach.catalog.views import VIEWS_SQL
from marketreach.layouts import STOPWORDS

CONTEXT = "canal IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
KEYWORD = (
    "(contains(lower(coalesce(nome_fantasia, '')), 'ring') OR contains(lower(coalesce(nome_fantasia, '')), 'bolt'))"
)
NAMED = "length(trim(coalesce(nome_fantasia, ''))) > 0"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
ACCENTS = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
NORM = (
    f"trim(regexp_replace(lower(regexp_replace(translate(text, '{ACCENTS}', '{PLAIN}'), "
    "'[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), ' ')"
)

MATCHED = """
matched AS (SELECT u.*, e.cnae_principal, e.cnae_principal_desc, left(e.cnae_principal, 4) AS classe,
                   e.uf, e.municipio_nome, e.razao_social, e.porte_desc
            FROM upload u LEFT JOIN est e USING (cnpj)),
classes AS (SELECT classe, count(*) AS n, sum(valor) AS v FROM matched GROUP BY classe),
acc AS (SELECT *, sum(n) OVER (ORDER BY n DESC, classe) / sum(n) OVER () AS cn,
               sum(v) OVER (ORDER BY v DESC, classe) / sum(v) OVER () AS cv,
               row_number() OVER (ORDER BY n DESC, classe) AS rn, row_number() OVER (ORDER BY v DESC, classe) AS rv
        FROM classes),
cuts AS (SELECT min(rn) FILTER (cn >= 0.95) AS kn, min(rv) FILTER (cv >= 0.95) AS kv FROM acc),
picked AS (SELECT acc.*, kn IS NULL OR rn <= kn AS vol, kv IS NULL OR rv <= kv AS val FROM acc, cuts)
"""

PORTFOLIO = f"""
codes_n AS (SELECT cnae_principal, cnae_principal_desc, count(DISTINCT cnpj) AS n_cnpjs,
                   sum(relevancia_valor) AS soma_valor
            FROM foco WHERE cliente_atendido AND {CONTEXT} GROUP BY ALL)
"""

KM = (
    "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin((radians(d.lat) - radians(c.lat)) / 2), 2)"
    " + cos(radians(c.lat)) * cos(radians(d.lat)) * pow(sin((radians(d.lon) - radians(c.lon)) / 2), 2))))"
)

INDIRECT = f"""
sellers AS (SELECT * FROM foco WHERE cliente_atendido AND canal = '1-URGENT'),
points AS (SELECT cnpj, cnpj_basico, razao_social, nome_fantasia, uf, lat, lon FROM sellers WHERE lat IS NOT NULL),
finals AS (SELECT * FROM foco WHERE NOT cliente_atendido),
dists AS (SELECT c.cnpj, d.cnpj AS dc, d.cnpj_basico AS dr, d.razao_social AS dn,
                 d.uf LIKE 'NATION_1%' AS uf_sel, {KM} AS km
          FROM finals c JOIN points d ON c.lat IS NOT NULL),
roots AS (SELECT DISTINCT cnpj_basico AS r FROM points WHERE uf LIKE 'NATION_1%'),
near AS (SELECT cnpj, arg_min(dc, (km, dc)) AS dc, arg_min(dr, (km, dc)) AS dr, arg_min(dn, (km, dc)) AS dn,
                min(km) AS km FROM dists GROUP BY cnpj),
near_sel AS (SELECT cnpj, arg_min(dc, (km, dc)) AS dc, min(km) AS km
             FROM dists WHERE dr IN (SELECT r FROM roots) GROUP BY cnpj),
kept AS (SELECT * FROM foco WHERE cliente_atendido OR {NAMED}),
cover AS (SELECT f.cnpj, f.cnpj_basico, f.razao_social, f.capital_social, f.lat, f.lon, f.cliente_atendido,
                 n.dc, n.dr, n.km, s.dc AS sdc, s.km AS skm, n.dr IN (SELECT r FROM roots) AS ours
          FROM kept f LEFT JOIN near n USING (cnpj) LEFT JOIN near_sel s USING (cnpj)
          WHERE NOT f.cliente_atendido OR NOT coalesce(f.canal = '1-URGENT', false)),
cat_all AS (SELECT *, CASE WHEN cliente_atendido THEN 'Atendido direto'
                           WHEN coalesce(km <= 150, false) THEN 'Dentro do raio (selecionados)'
                           ELSE 'Fora do raio' END AS via FROM cover),
cat_sel AS (SELECT *, CASE WHEN cliente_atendido THEN 'Atendido direto'
                           WHEN NOT coalesce(km <= 150, false) THEN 'Fora do raio'
                           WHEN ours THEN 'Dentro do raio (selecionados)'
                           ELSE 'Dentro do raio (outros distribuidores)' END AS via FROM cover),
cat_pri AS (SELECT *, CASE WHEN cliente_atendido THEN 'Atendido direto'
                           WHEN coalesce(skm <= 150, false) THEN 'Dentro do raio (selecionados)'
                           WHEN coalesce(km <= 150, false) THEN 'Dentro do raio (outros distribuidores)'
                           ELSE 'Fora do raio' END AS via FROM cover)
"""

VENN = """
seg AS (SELECT u.*, e.cnae_principal, e.cnae_principal_desc, e.uf,
               u.segmento = 'F' AND u.canal IN ('1-URGENT', '2-HIGH') AS ia,
               u.segmento = 'O' AND u.canal IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS ib,
               left(e.cnae_principal, 4) = '4701' AS ic
        FROM upload u JOIN est e USING (cnpj)),
mem AS (SELECT cnpj, bool_or(ia) AS a, bool_or(ib) AS b, bool_or(ic) AS c, sum(valor) AS v FROM seg GROUP BY cnpj),
reg AS (SELECT *, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) AS regiao FROM mem)
"""

LABELLED = """
lab AS (SELECT seg.*, CASE WHEN regiao = 1 THEN 'Mercado A' WHEN regiao = 3 THEN 'Mercado AB'
                           WHEN a THEN 'Sobra' END AS rotulo FROM seg JOIN reg USING (cnpj))
"""

RAW = """
rawe AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS cnpj_basico,
                lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0')
                || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0') AS cnpj,
                'Loja ' || CAST(l_orderkey AS VARCHAR) AS nome_fantasia, '02' AS situacao_cadastral,
                CASE WHEN l_orderkey % 5 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS inicio,
                lpad(CAST(l_orderkey % 100000 AS VARCHAR), 8, '0') AS cep, l_partkey, l_orderkey % 25 AS mun
         FROM lineitem WHERE l_returnflag <> 'R'),
rawc AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cnpj_basico, s_name AS razao_social,
                s_acctbal AS capital_social, CAST(s_suppkey % 7 AS INTEGER) AS porte,
                CASE s_suppkey % 7 WHEN 1 THEN 'Micro Empresa' WHEN 3 THEN 'Empresa de Pequeno Porte'
                     WHEN 5 THEN 'Demais' ELSE 'Não Informado' END AS porte_desc,
                n_name AS natureza_juridica_desc
         FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)
"""

EXPLORED = """
expl AS (SELECT * FROM est WHERE porte_desc IN ('Micro Empresa', 'Demais', 'Não Informado')
         AND (data_inicio_atividade IS NULL OR year(data_inicio_atividade) BETWEEN 1995 AND 1996))
"""

REPS = """
ceps AS (SELECT left(c, 5) AS cep5, c, count(*) AS n
         FROM (SELECT regexp_replace(cep, '[^0-9]', '', 'g') AS c FROM est) WHERE length(c) = 8 GROUP BY c),
reps AS (SELECT cep5, arg_min(c, (-n, c)) AS cep_usado, CAST(sum(n) AS BIGINT) AS n FROM ceps GROUP BY cep5),
pend AS (SELECT cep5, cep_usado, CAST(cep5 AS INTEGER) % 2 = 0 AS ok, CAST(cep5 AS INTEGER) AS num
         FROM reps WHERE cep5 NOT IN (SELECT cep5 FROM cache WHERE status IN ('ok', 'not_found')))
"""

OUTLINE = """
outl AS (SELECT 'doc' || n_regionkey AS doc, n_regionkey AS edition, chr(65 + n_regionkey) AS secao_cod, r_name AS secao_nome,
                lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS divisao_cod, n_name AS divisao_nome,
                CASE WHEN n_nationkey % 2 = 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '.1' ELSE '' END AS grupo_cod,
                CASE WHEN n_nationkey % 2 = 0 THEN 'Grupo ' || n_name ELSE '' END AS grupo_nome, '' AS classe_cod,
                lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-1/' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS subclasse_cod,
                c_name AS subclasse_nome, 'nota ' || c_mktsegment || ' nota ' || c_mktsegment AS notas_explicativas,
                n_nationkey * 1000000000000 + 10 + c_custkey * 10 AS pos
         FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([VIEWS_SQL, *ctes]) + select


def _pareto(metric: str, shown: bool = False) -> str:
    source = f"(SELECT * FROM codes_n ORDER BY {metric} DESC, cnae_principal LIMIT 10)" if shown else "codes_n"
    return _sql(
        f"""
        SELECT cnae_principal, rotulo, n_cnpjs, round(soma_valor, 2) AS soma_valor, round(pct, 6) AS pct,
               round(acc, 6) AS pct_acumulado, CASE WHEN acc <= 80 THEN 'A' WHEN acc <= 95 THEN 'B' ELSE 'C' END AS abc
        FROM (SELECT *, cnae_principal || ' – ' || left(cnae_principal_desc, 40) AS rotulo,
                     {metric} / sum({metric}) OVER () * 100 AS pct,
                     sum({metric}) OVER (ORDER BY {metric} DESC, cnae_principal) / sum({metric}) OVER () * 100 AS acc
              FROM {source})""",
        PORTFOLIO,
    )


def _served(key: str, ident: str, name: str, k: int, source: str) -> str:
    return f"""SELECT '{name}' AS id, {key} AS chave, s + u AS n_total, s AS n_atendidos, u AS n_nao_atendidos
        FROM (SELECT {key}, count(DISTINCT {ident}) FILTER (srv) AS s, count(DISTINCT {ident}) FILTER (NOT srv) AS u
              FROM {source} GROUP BY {key}) ORDER BY s + u DESC, {key} LIMIT {k}"""


def _shares(source: str) -> str:
    return _sql(
        f"""SELECT v AS atendimento_via, count(DISTINCT cnpj) AS clientes,
                   round(count(DISTINCT cnpj) / (SELECT count(DISTINCT cnpj) FROM {source}) * 100, 6) AS pct
            FROM (VALUES ('Atendido direto'), ('Dentro do raio (selecionados)'),
                         ('Dentro do raio (outros distribuidores)'), ('Fora do raio')) t(v)
            LEFT JOIN {source} ON via = v GROUP BY v""",
        INDIRECT,
    )


CELL = "CAST(round_even({c} / 0.05e0, 0) AS INTEGER)"
GRID = (
    "cells AS (SELECT i * 0.05e0 AS lat, j * 0.05e0 AS lon, count(*) AS n FROM (SELECT "
    + CELL.format(c="lat") + " AS i, " + CELL.format(c="lon")
    + " AS j FROM foco WHERE NOT cliente_atendido AND lat IS NOT NULL AND lon IS NOT NULL) GROUP BY i, j)"
)

JOB = "WITH " + RAW + """
    SELECT cnpj, cnpj_basico, nome_fantasia, inicio, cep, replace(razao_social, '#', chr(10)) AS razao_social, capital_social,
           porte, porte_desc FROM rawe LEFT JOIN rawc USING (cnpj_basico)"""

SQL: dict[str, str] = {
    "coverage_kpis": _sql(
        f"""
        SELECT count(DISTINCT cnpj) AS cnpjs, count(DISTINCT cnpj) FILTER (srv) AS cnpjs_atendidos,
               round(count(DISTINCT cnpj) FILTER (srv) / count(DISTINCT cnpj) * 100, 6) AS pct_cnpjs,
               count(DISTINCT cnpj_basico) AS empresas, count(DISTINCT cnpj_basico) FILTER (srv) AS empresas_atendidas,
               round(count(DISTINCT cnpj_basico) FILTER (srv) / count(DISTINCT cnpj_basico) * 100, 6) AS pct_empresas
        FROM (SELECT *, cliente_atendido OR empresa_base_atendida AS srv FROM foco
              WHERE NOT cliente_atendido OR coalesce({CONTEXT}, false))
        WHERE {NAMED} AND (srv OR NOT {KEYWORD})"""
    ),
    "pareto_abc_clients": _pareto("n_cnpjs"),
    "pareto_abc_value": _pareto("soma_valor"),
    "pareto_abc_shown": _pareto("n_cnpjs", shown=True),
    "subclass_totals": _sql(
        """
        SELECT t.cnae_principal, t.cnae_principal_desc, n_total, n_atend, CAST(coalesce(posicao, 0) AS INTEGER) AS posicao,
               round(coalesce(n_cnpjs / (SELECT greatest(sum(n_cnpjs), 1) FROM codes_n) * 100, 0), 6) AS pct_carteira,
               coalesce(posicao <= 10, false) AS pre_selecionada
        FROM (SELECT cnae_principal, cnae_principal_desc, count(DISTINCT cnpj) AS n_total,
                     count(DISTINCT CASE WHEN cliente_atendido THEN cnpj END) AS n_atend FROM foco GROUP BY ALL) t
        LEFT JOIN (SELECT *, row_number() OVER (ORDER BY n_cnpjs DESC, cnae_principal) AS posicao FROM codes_n) r
        USING (cnae_principal)""",
        PORTFOLIO,
    ),
    "market_context": _sql(
        f"""SELECT cnpj, cliente_atendido OR empresa_base_atendida AS cliente_atendido FROM foco
            WHERE NOT cliente_atendido OR coalesce({CONTEXT}, false)"""
    ),
    "market_cleaned": _sql(
        f"""SELECT cnpj, 'todos' AS regra FROM foco WHERE {NAMED} AND (cliente_atendido OR NOT {KEYWORD})
            UNION ALL SELECT cnpj, 'nao_atendidos' FROM foco
            WHERE (cliente_atendido OR {NAMED}) AND (cliente_atendido OR NOT {KEYWORD})"""
    ),
    "market_cleaned_by_index": _sql(
        f"""SELECT cnpj, 'todos' AS regra FROM foco WHERE {NAMED} AND (cliente_atendido OR NOT {KEYWORD})
            UNION ALL SELECT cnpj, 'nao_atendidos' FROM foco
            WHERE (cliente_atendido OR {NAMED}) AND (cliente_atendido OR NOT {KEYWORD})"""
    ),
    "keyword_search": _sql(
        """SELECT palavra, cnpj, count(*) AS linhas
           FROM foco JOIN (VALUES ('ring'), ('red w'), ('ot'), ('g'), ('all bolt')) AS k(palavra)
           ON contains(lower(nome_fantasia), palavra) GROUP BY palavra, cnpj"""
    ),
    "served_by_subclass": _sql(
        """
        SELECT cnae_principal || ' – ' || left(cnae_principal_desc, 35) AS rotulo, count(DISTINCT cnpj) AS n_total,
               count(DISTINCT cnpj) FILTER (cliente_atendido) AS n_atendidos,
               count(DISTINCT cnpj) FILTER (NOT cliente_atendido) AS n_nao_atendidos
        FROM foco WHERE cnae_principal IN (SELECT cnae_principal FROM foco GROUP BY 1
                                           ORDER BY count(DISTINCT cnpj) DESC, cnae_principal LIMIT 10)
        GROUP BY cnae_principal, cnae_principal_desc"""
    ),
    "served_by_key": _sql(
        "(" + _served("uf", "cnpj", "cnpj", 25, "m") + ") UNION ALL ("
        + _served("municipio_nome", "cnpj_basico", "empresa", 20, "m") + ")",
        "m AS (SELECT *, cliente_atendido OR empresa_base_atendida AS srv FROM foco)",
    ),
    "top_cities": _sql(
        "SELECT municipio_nome, uf, count(DISTINCT cnpj) AS n FROM foco GROUP BY ALL ORDER BY n DESC, municipio_nome, uf LIMIT 10"
    ),
    "ids_by_uf": _sql("SELECT uf, count(DISTINCT cnpj) AS n FROM foco GROUP BY uf"),
    "top_words": _sql(
        f"""SELECT palavra, count(*) AS freq FROM (SELECT unnest(string_split(lower(nome_fantasia), ' ')) AS palavra
            FROM foco WHERE NOT cliente_atendido AND nome_fantasia IS NOT NULL)
            WHERE length(palavra) > 2 AND palavra NOT IN ({STOP}) GROUP BY palavra ORDER BY freq DESC, palavra LIMIT 20"""
    ),
    "document_words": f"""SELECT palavra, count(*) AS freq FROM (SELECT unnest(string_split({NORM}, ' ')) AS palavra FROM documents)
            WHERE length(palavra) > 2 AND palavra NOT IN ({STOP}) GROUP BY palavra ORDER BY freq DESC, palavra LIMIT 50""",
    "normalised_documents": f"SELECT doc_id, md5({NORM}) AS digest FROM documents",
    "density_grid": _sql("SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, n FROM cells", GRID),
    "density_cap": _sql("SELECT greatest(quantile_cont(n, 0.9), 1e0) AS limite FROM cells", GRID),
    "unserved_by_uf": _sql(
        "SELECT uf, count(DISTINCT cnpj) AS n_nao_atendidos FROM foco WHERE NOT cliente_atendido GROUP BY uf"
    ),
    "context_values": _sql(
        """SELECT 'canal' AS coluna, canal AS valor FROM foco WHERE canal IS NOT NULL GROUP BY canal
           UNION ALL SELECT 'segmento', segmento FROM foco WHERE segmento IS NOT NULL GROUP BY segmento"""
    ),
    "class_cutoff_95": _sql(
        """
        SELECT classe, n AS n_clientes, round(v, 2) AS valor_total, round_even(n / sum(n) OVER () * 100, 1) AS pct_vol,
               round_even(v / sum(v) OVER () * 100, 1) AS pct_val,
               CASE WHEN vol AND val THEN 'Vol + Val' WHEN vol THEN 'Volume' WHEN val THEN 'Valor' ELSE '—' END AS criterio,
               vol OR val AS selecionada, 'Classe ' || classe AS classe_desc
        FROM picked""",
        MATCHED,
    ),
    "class_top_subclasses": _sql(
        """
        SELECT classe, cnae_principal, n_clientes, CAST(posicao AS INTEGER) AS posicao
        FROM (SELECT classe, cnae_principal, count(*) AS n_clientes,
                     row_number() OVER (PARTITION BY classe ORDER BY count(*) DESC, cnae_principal) AS posicao
              FROM matched GROUP BY classe, cnae_principal) WHERE posicao <= 5""",
        MATCHED,
    ),
    "labelled_codes": _sql(
        """SELECT cnae_principal || ' · ' || left(cnae_principal_desc, 55) AS rotulo, count(*) AS n, round(sum(valor), 2) AS valor
           FROM matched GROUP BY ALL""",
        MATCHED,
    ),
    "upload_top_codes": _sql(
        """(SELECT *, 'clientes' AS criterio FROM t ORDER BY n DESC, rotulo LIMIT 10)
           UNION ALL (SELECT *, 'valor' FROM t ORDER BY valor DESC, rotulo LIMIT 10)""",
        MATCHED,
        """t AS (SELECT cnae_principal || ' · ' || left(cnae_principal_desc, 55) AS rotulo, count(*) AS n,
                 round(sum(valor), 2) AS valor FROM matched GROUP BY ALL)""",
    ),
    "combined_score": _sql(
        """SELECT cnae_principal, n, round(v, 2) AS valor, round(n / max(n) OVER () + v / max(v) OVER (), 6) AS score
           FROM (SELECT cnae_principal, count(*) AS n, sum(valor) AS v FROM matched GROUP BY 1)""",
        MATCHED,
    ),
    "focus_build": _sql(
        """
        SELECT cnpj, cnae_principal, cliente_atendido, bool_or(cliente_atendido) OVER (PARTITION BY cnpj_basico) AS empresa_base_atendida,
               round(relevancia_valor, 2) AS relevancia_valor, canal, round(clat, 6) AS lat, round(clon, 6) AS lon, cd_mun AS "CD_MUN"
        FROM marked LEFT JOIN centroids USING (municipio_nome, uf)
        WHERE left(cnae_principal, 4) IN (SELECT classe FROM picked WHERE vol OR val)""",
        MATCHED,
    ),
    "focus_classes": _sql(
        "SELECT left(cnae_principal, 4) AS classe, count(*) AS linhas FROM est WHERE left(cnae_principal, 4) IN ('4701', '4713', '4725') GROUP BY 1"
    ),
    "enrich_base_wins": _sql("SELECT linha, cnpj, uf, municipio_nome, cnae_principal, razao_social FROM matched", MATCHED),
    "enrich_user_wins": _sql(
        """SELECT linha, '??' AS uf, municipio_nome, valor, round(sum(valor) OVER (PARTITION BY cnpj), 2) AS valor_total, porte_desc
           FROM matched""",
        MATCHED,
    ),
    "enrich_pivot": _sql(
        """
        SELECT cnpj AS "CNPJ",
        """
        + ", ".join(
            f"""round(sum(valor) FILTER (segmento = '{s}'), 2) AS "valor_{s}",
                arg_min(canal, linha) FILTER (segmento = '{s}') AS "canal_{s}",
                max(segmento) FILTER (segmento = '{s}') AS "segmento_{s}" """
            for s in ("F", "O", "P")
        )
        + ", round(sum(valor), 2) AS valor_total, min(uf) AS uf FROM matched GROUP BY cnpj",
        MATCHED,
    ),
    "match_rate": _sql(
        "SELECT (SELECT count(*) FROM matched) AS encontrados, (SELECT count(*) FROM upload) AS linhas, "
        "round_even((SELECT count(*) FROM matched) / (SELECT count(*) FROM upload) * 100, 1) AS pct",
        MATCHED,
    ),
    "secondary_codes": _sql(
        "SELECT cnae, count(*) AS ocorrencias FROM (SELECT unnest(string_split(cnaes_secundarios, ',')) AS cnae FROM est) WHERE cnae <> '' GROUP BY cnae"
    ),
    "guess_value_column": _sql(
        """
        SELECT c AS "column", round(avg(CASE WHEN TRY_CAST(replace(x, ',', '.') AS DOUBLE) IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS share
        FROM (SELECT 'linha' AS c, CAST(linha AS VARCHAR) AS x FROM upload
              UNION ALL SELECT 'CNPJ', left(cnpj, 8) || '/' || substr(cnpj, 9, 4) || '-' || substr(cnpj, 13, 2) FROM upload
              UNION ALL SELECT 'valor', replace(CAST(valor AS VARCHAR), '.', ',') FROM upload
              UNION ALL SELECT 'canal', canal FROM upload UNION ALL SELECT 'segmento', segmento FROM upload) GROUP BY c"""
    ),
    "upload_duplicates": _sql(
        "SELECT count(*) AS linhas, count(DISTINCT cnpj) AS distintos, count(DISTINCT cnpj) < count(*) AS tem_repetidos FROM upload"
    ),
    "upload_filters": _sql(
        """SELECT count(*) AS filtradas, count(cnae_principal) AS com_cnae, count(*) - count(cnae_principal) AS sem_cnae
           FROM matched WHERE canal IN ('1-URGENT', '5-LOW')""",
        MATCHED,
    ),
    "nearest_distributor": _sql(
        """SELECT f.cnpj, dc AS cnpj_distrib_proximo, dr AS cnpj_basico_distrib, dn AS razao_distrib, round(km, 6) AS dist_km_min
           FROM finals f LEFT JOIN near USING (cnpj)""",
        INDIRECT,
    ),
    "coverage_by_radius": _shares("cat_all"),
    "coverage_selected": _shares("cat_sel"),
    "coverage_prioritised": _sql(
        """SELECT cnpj, via AS atendimento_via,
                  CASE WHEN via = 'Dentro do raio (selecionados)' THEN sdc ELSE dc END AS cnpj_distrib_proximo,
                  round(CASE WHEN via = 'Dentro do raio (selecionados)' THEN skm ELSE km END, 6) AS dist_km_min
           FROM cat_pri WHERE NOT cliente_atendido""",
        INDIRECT,
    ),
    "clients_per_distributor": _sql(
        """
        SELECT left((SELECT min(razao_social) FROM points p WHERE p.cnpj_basico = dr), 40) || ' [' || dr || ']' AS distribuidor,
               dr AS cnpj_basico_distrib, count(*) FILTER (via = 'Dentro do raio (selecionados)') AS dentro,
               count(*) FILTER (via = 'Dentro do raio (outros distribuidores)') AS dentro_outros,
               count(*) FILTER (via = 'Fora do raio') AS fora
        FROM cat_sel WHERE NOT cliente_atendido AND dr IS NOT NULL GROUP BY dr""",
        INDIRECT,
    ),
    "distributor_choices": _sql(
        """
        SELECT dr AS cnpj_basico_distrib,
               left(min(dn), 50) || '  /  ' || left(coalesce(min(nf), ''), 30) || '  [' || dr || ']' AS rotulo
        FROM (SELECT c.dr, p.razao_social AS dn, p.nome_fantasia AS nf
              FROM cat_all c JOIN points p ON p.cnpj = c.dc WHERE NOT c.cliente_atendido) GROUP BY dr""",
        INDIRECT,
    ),
    "indirect_export": _sql(
        """
        SELECT cnpj, razao_social, capital_social, via AS atendimento_via, dc AS cnpj_distrib_proximo,
               (SELECT min(razao_social) FROM points p WHERE p.cnpj_basico = dr) AS distrib_empresa_mae,
               (SELECT razao_social FROM points p WHERE p.cnpj = dc) AS distrib_razao_social, round(km, 6) AS dist_km_min
        FROM cat_all WHERE via = 'Fora do raio'""",
        INDIRECT,
    ),
    "indirect_density": _sql(
        """SELECT via AS atendimento_via, CASE WHEN quantile_cont(n, 0.9) = 0 THEN 1e0 ELSE quantile_cont(n, 0.9) END AS limite
           FROM (SELECT via, i, j, count(*) AS n FROM (SELECT via, """
        + CELL.format(c="lat") + " AS i, " + CELL.format(c="lon")
        + " AS j FROM cat_sel WHERE NOT cliente_atendido AND lat IS NOT NULL) GROUP BY ALL) GROUP BY via",
        INDIRECT,
    ),
    "distributor_value_rank": _sql(
        """SELECT cnpj_basico, left(coalesce(p.nm, ''), 55) || '  [' || cnpj_basico || ']' AS rotulo, p.nf AS nome_fantasia,
                  round(v, 2) AS soma_valor
           FROM (SELECT cnpj_basico, min(razao_social) AS nm, min(nome_fantasia) AS nf FROM points GROUP BY 1) p
           LEFT JOIN (SELECT cnpj_basico, sum(relevancia_valor) AS v FROM sellers GROUP BY 1) USING (cnpj_basico)""",
        INDIRECT,
    ),
    "venn3_regions": _sql(
        """
        SELECT regiao, concat_ws(' ∩ ', CASE WHEN a THEN 'F · 1-URGENT, 2-HIGH' END, CASE WHEN b THEN 'O · 2-HIGH a 4' END,
                                 CASE WHEN c THEN 'CNAE 4701' END) AS nome,
               concat_ws(', ', CASE WHEN NOT a THEN '¬F · 1-URGENT, 2-HIGH' END, CASE WHEN NOT b THEN '¬O · 2-HIGH a 4' END,
                         CASE WHEN NOT c THEN '¬CNAE 4701' END) AS exclui, count(*) AS n, round(sum(v), 2) AS valor
        FROM reg WHERE regiao > 0 GROUP BY regiao, a, b, c""",
        VENN,
    ),
    "venn3_set_sizes": _sql(
        "SELECT count(*) FILTER (a) AS tamanho_a, count(*) FILTER (b) AS tamanho_b, count(*) FILTER (c) AS tamanho_c FROM mem", VENN
    ),
    "venn3_region_top10": _sql(
        """
        SELECT regiao, CAST(posicao AS INTEGER) AS posicao, linha, cnpj, uf, replace(CAST(valor AS VARCHAR), '.', ',') AS valor
        FROM (SELECT seg.*, regiao, row_number() OVER (PARTITION BY regiao ORDER BY valor DESC, linha) AS posicao
              FROM seg JOIN reg USING (cnpj) WHERE regiao > 0) WHERE posicao <= 10""",
        VENN,
    ),
    "segment_top_codes": _sql(
        """
        SELECT cnae_principal, min(d) AS cnae_principal_desc, CAST(sum(n) AS BIGINT) AS n_cnpjs FROM (
          (SELECT cnae_principal, min(cnae_principal_desc) AS d, count(DISTINCT cnpj) AS n FROM seg WHERE ia GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)
          UNION ALL
          (SELECT cnae_principal, min(cnae_principal_desc) AS d, count(DISTINCT cnpj) AS n FROM seg WHERE ib GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5))
        GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5""",
        VENN,
    ),
    "segment_sizes": _sql(
        """SELECT 'A' AS conjunto, count(DISTINCT cnpj) AS n_cnpjs FROM seg WHERE ia
           UNION ALL SELECT 'B', count(DISTINCT cnpj) FROM seg WHERE ib""",
        VENN,
    ),
    "segment_apply": _sql(
        "SELECT rotulo, count(*) AS qtd, round_even(count(*) / (SELECT count(*) FROM lab) * 100, 1) AS pct FROM lab GROUP BY rotulo",
        VENN, LABELLED,
    ),
    "version_diff": _sql("SELECT count(*) FILTER (regiao = 1) AS rows_changed FROM seg JOIN reg USING (cnpj)", VENN),
    "etl_unified": "WITH " + RAW + """
        SELECT cnpj, cnpj_basico, nome_fantasia, situacao_cadastral, inicio, cep, razao_social, capital_social, porte, porte_desc,
               natureza_juridica_desc, p_name AS cnae_principal_desc, n_name AS municipio_nome, CAST(NULL AS VARCHAR) AS opcao_mei
        FROM rawe LEFT JOIN rawc USING (cnpj_basico) LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN nation ON n_nationkey = mun""",
    "etl_hierarchy_join": _sql(
        "SELECT secao, classe, count(*) AS linhas FROM est LEFT JOIN hier ON subclasse = cnae_principal GROUP BY secao, classe"
    ),
    "etl_partners": """
        SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cnpj_basico, 'Socio ' || o_orderkey AS nome_socio,
               left(o_orderpriority, 1) AS qualificacao_socio,
               CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS qualificacao_socio_desc,
               strftime(o_orderdate, '%Y-%m-%d') AS entrada, o_orderstatus AS faixa_etaria FROM orders""",
    "etl_simples": _sql(
        """
        SELECT est.cnpj, s.s_name AS razao_social, r.op AS opcao_simples, strftime(r.d, '%Y-%m-%d') AS desde,
               CAST(NULL AS VARCHAR) AS ate, CASE WHEN r.root IS NOT NULL THEN 'N' END AS opcao_mei
        FROM est LEFT JOIN supplier s ON lpad(CAST(s_suppkey AS VARCHAR), 8, '0') = est.cnpj_basico
        LEFT JOIN (SELECT lpad(CAST(o_custkey * 2 AS VARCHAR), 8, '0') AS root, min(o_orderstatus) AS op, min(o_orderdate) AS d
                   FROM orders GROUP BY o_custkey) r ON r.root = est.cnpj_basico"""
    ),
    "repeated_roots": _sql("SELECT cnpj_basico, count(*) AS linhas FROM est GROUP BY 1 HAVING count(*) > 1"),
    "explore_filtered": _sql(
        """SELECT count(*) AS estabelecimentos, count(DISTINCT uf) AS ufs, count(DISTINCT cnae_principal) AS cnaes,
                  count(DISTINCT municipio_nome) AS municipios FROM expl""",
        EXPLORED,
    ),
    "explore_distributions": _sql(
        """
        (SELECT 'uf' AS tipo, uf AS valor, count(*) AS qtd FROM expl GROUP BY uf)
        UNION ALL SELECT 'porte', coalesce(porte_desc, 'Não Informado'), count(*) FROM est GROUP BY 2
        UNION ALL SELECT 'ano', CAST(year(data_inicio_atividade) AS VARCHAR), count(*) FROM expl
                  WHERE year(data_inicio_atividade) >= 1970 GROUP BY 2
        UNION ALL (SELECT 'cnae', cnae_principal || ' · ' || left(min(cnae_principal_desc), 60), count(*) FROM expl
                   GROUP BY cnae_principal ORDER BY 3 DESC, cnae_principal LIMIT 15)""",
        EXPLORED,
    ),
    "capital_boxstats": _sql(
        """
        SELECT rotulo, count(*) AS n, round(min(x), 4) AS minimo, round(quantile_cont(x, 0.25), 4) AS q1,
               round(quantile_cont(x, 0.5), 4) AS mediana, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS maximo,
               round(avg(x), 4) AS media
        FROM (SELECT rotulo, x FROM best UNION ALL SELECT 'TOTAL', x FROM best) GROUP BY rotulo""",
        """
        firms AS (SELECT cnpj_basico, arg_min(cnae_principal_desc, cnpj) AS d, arg_min(capital_social, cnpj) AS x FROM est GROUP BY 1),
        pos AS (SELECT * FROM firms WHERE x > 0),
        lim AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM pos),
        trimmed AS (SELECT left(d, 50) AS rotulo, x FROM pos, lim WHERE x BETWEEN lo AND hi),
        best AS (SELECT * FROM trimmed WHERE rotulo IN (SELECT rotulo FROM trimmed GROUP BY 1 ORDER BY count(*) DESC, rotulo LIMIT 10))""",
    ),
    "code_search": _sql(
        """SELECT cnae_principal, count(*) AS linhas FROM est
           WHERE cnae_principal IN (SELECT subclasse FROM hier WHERE contains(lower(subclasse_desc), 'economy') AND secao IN ('A', 'C'))
           GROUP BY 1"""
    ),
    "code_lookup": _sql(
        """SELECT subclasse, subclasse_desc, secao, (SELECT count(*) FROM est WHERE cnae_principal = '4701001') AS estabelecimentos
           FROM hier WHERE subclasse = '4701001'"""
    ),
    "hierarchy_summary": _sql(
        """SELECT secao, secao_desc, count(DISTINCT divisao) AS divisoes, count(DISTINCT grupo) AS grupos,
                  count(DISTINCT classe) AS classes, count(subclasse) AS subclasses FROM hier GROUP BY ALL"""
    ),
    "hierarchy_levels": _sql(
        """SELECT count(DISTINCT secao) AS secao, count(DISTINCT divisao) AS divisao, count(DISTINCT grupo) AS grupo,
                  count(DISTINCT classe) AS classe, count(DISTINCT subclasse) AS subclasse FROM hier"""
    ),
    "cep_prefix_stats": _sql(
        """SELECT count(*) FILTER (length(c) = 8) AS ceps_validos, count(DISTINCT left(c, 5)) FILTER (length(c) = 8) AS prefixos
           FROM (SELECT regexp_replace(coalesce(cep, ''), '[^0-9]', '', 'g') AS c FROM est)"""
    ),
    "cep_representatives": _sql("SELECT cep5, cep_usado, n FROM reps", REPS),
    "cache_pending": _sql("SELECT cep5, cep_usado FROM pend", REPS),
    "cache_upsert": _sql(
        """
        SELECT coalesce(p.cep5, c.cep5) AS cep5,
               CASE WHEN p.cep5 IS NOT NULL THEN (CASE WHEN p.ok THEN 'ok' ELSE 'not_found' END) ELSE c.status END AS status,
               CASE WHEN p.cep5 IS NOT NULL THEN '2024-06-01T00:00:00' ELSE '2024-01-01T00:00:00' END AS "timestamp",
               round(CASE WHEN p.cep5 IS NOT NULL THEN (CASE WHEN p.ok THEN -10e0 - p.num * 0.001e0 END) ELSE c.lat END, 6) AS lat
        FROM cache c FULL OUTER JOIN pend p ON p.cep5 = c.cep5""",
        REPS,
    ),
    "cache_stats": _sql(
        """SELECT (SELECT count(*) FROM reps) - count(*) AS cache_hits, count(*) FILTER (ok) AS novos_ok,
                  count(*) FILTER (NOT ok) AS novos_nao_encontrados FROM pend""",
        REPS,
    ),
    "geo_precedence": _sql(
        """SELECT cnpj, round(coalesce(c.lat, clat), 6) AS lat, round(coalesce(c.lon, clon), 6) AS lon, cd_mun AS "CD_MUN"
           FROM est LEFT JOIN centroids USING (municipio_nome, uf)
           LEFT JOIN (SELECT * FROM cache WHERE lat IS NOT NULL) c
           ON left(regexp_replace(coalesce(cep, ''), '[^0-9]', '', 'g'), 5) = c.cep5"""
    ),
    "geocoded_rows": _sql(
        """SELECT count(c.lat) AS com_coordenada, count(*) AS linhas FROM est LEFT JOIN (SELECT * FROM cache WHERE lat IS NOT NULL) c
           ON left(regexp_replace(coalesce(cep, ''), '[^0-9]', '', 'g'), 5) = c.cep5"""
    ),
    "outline_filldown": "WITH " + OUTLINE + """
        SELECT doc, secao_cod, secao_nome, divisao_cod, divisao_nome, grupo_cod, grupo_nome, classe_cod, subclasse_cod,
               subclasse_nome, notas_explicativas FROM outl""",
    "outline_editions": "WITH " + OUTLINE + """
        SELECT regexp_replace(subclasse_cod, '[^0-9]', '', 'g') AS subclasse_cod_num, arg_max(doc, (edition, pos)) AS doc,
               arg_max(subclasse_nome, (edition, pos)) AS subclasse_nome FROM outl GROUP BY 1""",
    "served_share": _sql(
        """SELECT uf, count(*) AS n, count(*) FILTER (cliente_atendido) AS atendidos,
                  round_even(count(*) FILTER (cliente_atendido) / count(*) * 100, 1) AS pct FROM foco GROUP BY uf"""
    ),
    "register_job": JOB,
    "register_rebuild": JOB,
    "register_refresh": JOB,
    "malformed_records": """SELECT '"' || s_suppkey || '";"' || s_name || '"' AS record FROM supplier WHERE s_suppkey % 10 = 0""",
    "landing_inventory": """
        SELECT CASE doc_id % 4 WHEN 0 THEN 'empresas' WHEN 1 THEN 'estabelecimentos' WHEN 2 THEN 'socios' ELSE 'auxiliares' END AS grupo,
               count(*) AS arquivos, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1""",
    "upload_line_breaks": """
        SELECT CAST(o_orderkey AS VARCHAR) AS linha, o_orderpriority AS canal, o_orderpriority || chr(10) || o_orderstatus AS obs FROM orders""",
    "version_list": _sql(
        """SELECT 0::INTEGER AS version, 'inicio' AS label, count(*) AS rows, 0::BIGINT AS rows_changed FROM seg
           UNION ALL SELECT 1, 'regiao', (SELECT count(*) FROM seg), count(*) FILTER (regiao = 1) FROM seg JOIN reg USING (cnpj)""",
        VENN,
    ),
    "version_load": _sql(
        "SELECT CASE WHEN regiao = 1 THEN 'A' END AS segmentacao, count(*) AS qtd FROM seg LEFT JOIN reg USING (cnpj) GROUP BY 1", VENN
    ),
    "segmentation_job": _sql(
        """SELECT CASE regiao WHEN 1 THEN 'A' WHEN 3 THEN 'AB' END AS segmentacao, count(*) AS qtd
           FROM seg LEFT JOIN reg USING (cnpj) GROUP BY 1""",
        VENN,
    ),
    "venn3_through_register": _sql(
        """
        SELECT CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) AS regiao, count(*) AS n, round(sum(v), 2) AS valor
        FROM (SELECT cnpj, bool_or(segmento = 'F' AND canal IN ('1-URGENT', '2-HIGH')) AS a,
                     bool_or(segmento = 'O' AND canal IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) AS b,
                     cnpj IN (SELECT cnpj FROM est WHERE cnae_principal = '4705001') AS c, sum(valor) AS v
              FROM upload GROUP BY cnpj) GROUP BY regiao"""
    ),
    "coordinates_job": _sql(
        """
        SELECT cnpj, round(m.lat, 6) AS lat, round(m.lon, 6) AS lon
        FROM est LEFT JOIN (
            SELECT cep5, lat, lon FROM cache WHERE status IN ('ok', 'not_found') AND lat IS NOT NULL
            UNION ALL SELECT cep5, -10e0 - num * 0.001e0, -50e0 - num * 0.001e0 FROM pend WHERE ok) m
        ON left(regexp_replace(coalesce(cep, ''), '[^0-9]', '', 'g'), 5) = m.cep5""",
        REPS,
    ),
}
