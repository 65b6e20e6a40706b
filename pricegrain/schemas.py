"""The relations of a purchase history, as explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

STORES = "id long, cadeia string, tipo string, nome string, nif string, localizacao string, criado_em timestamp_ntz"
PRODUCTS = "id long, nome_canonico string, nome_simplificado string, marca string, categoria string, unidade_base string, formato_valor decimal(10,3)"
RECEIPTS = (
    "id long, loja_id long, data_compra timestamp_ntz, numero_fatura string, total_impresso decimal(10,2), total_reconciliado decimal(10,2), discrepancia decimal(10,2), needs_review boolean, "
    "extracao_json string, desconto_global decimal(10,2), ficheiro_original string, metodo_extracao string, origem_captura string, modelo string, criado_em timestamp_ntz"
)
ITEMS = (
    "id long, fatura_id long, sku_id long, descricao_original string, linha_peso string, quantidade decimal(10,3), preco_unitario decimal(10,4), preco_liquido decimal(10,2), "
    "preco_por_base decimal(10,4), is_clearance boolean, desconto_direto decimal(10,2), is_non_product boolean"
)
ALIASES = "descricao_original string, sku_id long, origem string"
MESSAGES = "id long, utilizador string, papel string, conteudo string, criado_em timestamp_ntz"
FACTS = "id long, utilizador string, fato string"
CALLS = "id long, contexto string, modelo string, prompt_tokens int, completion_tokens int, custo decimal(12,8), criado_em timestamp_ntz"
REVIEWS = "id long, fatura_id long, veredicto string, comentario string, operador string, criado_em timestamp_ntz"

TABLES = {"loja": STORES, "sku_normalizado": PRODUCTS, "fatura": RECEIPTS, "item": ITEMS, "sku_alias": ALIASES, "mensagem": MESSAGES, "perfil": FACTS, "custo_chamada": CALLS, "revisao": REVIEWS}

#: A receipt as an extraction step hands it over.
LINE = "descricao_original string, valor double, desconto_direto double, quantidade double, preco_unitario double, is_clearance boolean, is_non_product boolean"
EXTRACTION = f"loja struct<cadeia:string,nome:string,nif:string,localizacao:string>, data_compra string, numero_fatura string, total_impresso double, desconto_global double, iva double, itens array<struct<{', '.join(f.replace(' ', ':') for f in LINE.split(', '))}>>"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
