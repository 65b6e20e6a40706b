"""The functions that an assistant may call by name, and the loop that calls them for an injected planner."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..sources.tables import Store
from . import purchases


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    says: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def definition(self, name: str) -> dict[str, Any]:
        """As function-calling interfaces want it."""
        kind = lambda p: {"type": "integer" if p == "min_idas" else "string"}
        return {"type": "function", "function": {"name": name, "description": self.says, "parameters": {"type": "object", "properties": {p: kind(p) for p in (*self.required, *self.optional)}, "required": list(self.required)}}}


PERIOD = ("periodo_inicio", "periodo_fim")
TOOLS = {
    "buscar_ultima_compra": Tool(purchases.last_purchase, "The most recent purchase of a product: price, store and day.", ("produto",)),
    "comparar_precos_por_loja": Tool(purchases.compare_stores, "A product's newest price per unit in each store, cheapest first.", ("produto",)),
    "historico_preco": Tool(purchases.price_history, "A product's prices over time.", ("produto",), ("desde",)),
    "total_gasto": Tool(purchases.total_spent, "What was spent, on a product or category, in a store or a period.", (), ("alvo", "loja", *PERIOD)),
    "listar_compras": Tool(purchases.list_purchases, "What was bought, line by line or by product.", (), (*PERIOD, "alvo", "loja", "agrupar_por")),
    "produto_mais_barato": Tool(purchases.cheapest_products, "The cheapest products of a kind per unit.", ("alvo",), ("loja",)),
    "detalhes_fatura": Tool(purchases.receipt_details, "The lines of one receipt, the newest by default.", (), ("loja", "data")),
    "produtos_habituais": Tool(purchases.habitual_products, "Products bought on several trips.", (), ("min_idas", *PERIOD, "loja")),
}
REMEMBER = Tool(lambda store, fato: None, "Keeps a lasting fact about the user.", ("fato",))


def definitions() -> list[dict[str, Any]]:
    return [t.definition(n) for n, t in {**TOOLS, "lembrar": REMEMBER}.items()]


def call(store: Store, name: str, arguments: dict[str, Any]) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}")
    tool = TOOLS[name]
    known = {k: v for k, v in arguments.items() if k in (*tool.required, *tool.optional) and v is not None}
    if missing := [p for p in tool.required if p not in known]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return tool.run(store, **known)


def answer(store: Store, question: str, planner: Callable[[list[dict]], dict], keep: Callable[[str], None] | None = None, rounds: int = 5, most_rows: int = 200) -> str:
    """Asks the planner for calls or an answer, up to `rounds` times. Results go back as JSON, at most `most_rows` rows each.

    Arguments that are no JSON count as none, and a failed call is told to the planner.
    """
    messages: list[dict] = [{"role": "user", "content": question}]
    for _ in range(rounds):
        said = planner(messages)
        if not said.get("tool_calls"):
            return said.get("content") or ""
        messages.append(said)
        for wanted in said["tool_calls"]:
            try:
                arguments = json.loads(wanted.get("arguments") or "{}")
            except ValueError:
                arguments = {}
            try:
                if wanted["name"] == "lembrar":
                    if keep:
                        keep(str(arguments.get("fato", "")))
                    result: Any = {"ok": True}
                else:
                    result = [json.loads(r) for r in call(store, wanted["name"], arguments).limit(most_rows).toJSON().collect()]
            except Exception as error:  # noqa: BLE001  the planner decides what to do about it
                result = {"erro": str(error)}
            messages.append({"role": "tool", "name": wanted["name"], "content": json.dumps(result, ensure_ascii=False)})
    return "Não consegui responder a isso."
