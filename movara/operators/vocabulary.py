"""Business vocabularies that name metrics, dimensions, domains and periods."""

NEGATIVE_ALLOWED_TERMS = ("lucro", "margem", "saldo")
PURCHASE_WORDS = ("compra", "custo", "despesa", "gasto")
SALES_WORDS = ("receita", "faturamento", "venda")
SHORT_IDENTIFIER_TERMS = ("id", "codigo", "cod", "sku", "nf")
YEAR_TERMS = ("ano", "year", "exercicio", "fiscal", "fy", "gaap")
MONTH_TERMS = ("mes", "month", "competencia")
PERIOD_TERMS = ("mes", "month", "trim", "trimestre", "quarter", "periodo", "competencia")
DATE_NAME_TERMS = (
    "data", "date", "mes", "month", "trim", "trimestre", "quarter", "periodo", "competencia", "timestamp",
)

VALUE_TERMS = (
    "valor_total", "total_venda", "valor_liquido", "valor_bruto", "faturamento", "receita", "receita_bruta",
    "receita_liquida", "venda", "vendas", "valor_venda", "compra", "compras", "valor_compra", "custo", "custos",
    "despesa", "gasto", "valor", "total", "preco", "amount", "price", "lucro", "margem",
)

DASHBOARD_METRIC_TERMS = {
    "vendas": ("faturamento", "receita", "venda", "vendas", "valor"),
    "compras": ("compra", "compras", "custo", "despesa", "gasto", "valor"),
    "financeiro": ("receita", "despesa", "custo", "lucro", "margem", "valor"),
    "estoque": ("valor", "quantidade", "qtd", "estoque", "preco"),
    "clientes": ("valor", "receita", "venda", "compras"),
}

DASHBOARD_DOMAINS = {
    "vendas": ("venda", "vendas", "faturamento", "receita", "cliente", "produto", "canal"),
    "compras": ("compra", "compras", "fornecedor", "custo", "despesa", "gasto"),
    "clientes": ("cliente", "customer", "comprador", "segmento", "cidade", "estado"),
    "estoque": ("estoque", "produto", "sku", "quantidade", "qtd", "categoria"),
    "financeiro": ("receita", "despesa", "custo", "lucro", "margem", "saldo", "valor"),
}

DIMENSION_GROUPS = {
    "produto": ("produto", "item", "sku", "servico", "produto_servico"),
    "fornecedor": ("fornecedor", "supplier", "vendor"),
    "cliente": ("cliente", "customer", "comprador"),
    "categoria": ("categoria", "segmento", "tipo", "classe", "familia"),
    "regiao": ("regiao", "estado", "cidade", "uf", "pais", "local"),
    "canal": ("canal", "origem", "midia", "loja", "vendedor"),
    "status": ("status", "situacao", "etapa"),
}

ANALYSIS_DOMAINS = {
    "estoque_operacao": (
        "estoque", "inventario", "volume", "industrializado", "producao", "fabrica", "ton", "sku", "produto", "custo",
    ),
    "vendas": ("venda", "receita", "faturamento", "cliente", "produto", "canal", "valor_total"),
    "compras": ("compra", "fornecedor", "custo", "despesa", "pedido", "prazo"),
    "financeiro": ("receita", "despesa", "custo", "lucro", "margem", "saldo", "valor"),
}

PRIMARY_METRICS = {
    "estoque_operacao": ("estoque_total", "estoque", "saldo_estoque", "inventario", "stock"),
    "vendas": ("valor_total", "receita", "faturamento", "valor_venda", "venda", "sales", "revenue"),
    "compras": ("valor_compra", "compra", "custo", "despesa", "gasto", "valor_total"),
    "financeiro": ("receita", "despesa", "custo", "lucro", "saldo", "valor_total", "valor"),
    "generico": ("valor_total", "valor", "total", "quantidade", "qtd", "volume"),
}

SUPPORT_METRICS = {
    "estoque_operacao": {
        "estoque_fabrica": ("estoque_fabrica", "fabrica", "warehouse", "factory_stock"),
        "volume_operacional": ("volume", "industrializado", "producao", "quantidade", "qtd"),
        "custo": ("custo", "cost", "preco", "price"),
    },
    "vendas": {
        "quantidade": ("quantidade", "qtd", "volume", "unidade"),
        "volume_vendido": ("volume_vendido", "volume", "vendido", "ton", "kg"),
        "qtd_pedidos": ("qtd_pedidos", "pedidos", "pedido"),
        "desconto": ("desconto", "abatimento"),
        "devolucoes": ("devolucao", "devolucoes", "retorno", "cancelamento"),
        "oee": ("oee", "eficiencia"),
        "taxa_aprovacao": ("taxa_aprovacao", "aprovacao", "aprovado"),
        "margem_ebitda": ("margem_ebitda", "ebitda", "margem"),
        "custo": ("custo", "cost"),
    },
    "compras": {
        "quantidade": ("quantidade", "qtd", "volume", "unidade"),
        "prazo": ("prazo", "lead_time", "dias"),
    },
    "financeiro": {"margem": ("margem", "margin"), "quantidade": ("quantidade", "qtd", "volume")},
    "generico": {},
}

ANALYSIS_DIMENSIONS = {
    "estoque_operacao": ("produto", "sku", "categoria", "fy_gaap", "gaap", "fabrica", "local", "familia"),
    "vendas": ("produto", "cliente", "categoria", "canal", "regiao", "vendedor"),
    "compras": ("fornecedor", "item", "produto", "categoria", "comprador", "status"),
    "financeiro": ("categoria", "centro_custo", "conta", "cliente", "fornecedor"),
    "generico": ("produto", "categoria", "cliente", "fornecedor", "status"),
}

BUSINESS_VALUE_TERMS = (
    "valor", "valor_total", "total", "receita", "faturamento", "venda", "vendas", "compra", "compras", "custo",
    "despesa", "gasto", "preco", "lucro", "margem",
)
AUDIT_NEGATIVE_ALLOWED = ("desconto", "devolucao", "estorno", "cancelamento", "saldo", "lucro", "margem")
DATED_DOMAINS = ("vendas", "compras", "clientes", "financeiro")
