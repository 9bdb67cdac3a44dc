"""Which business role does each column play? Decided from the header alone, no Spark job."""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

# The header keywords of each role, strongest first, in the order roles are settled.
ROLE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "sales": ("sales", "revenue", "order_total", "total_sales", "total_amount", "grand_total", "turnover"),
    "price": ("unit_price", "price", "unitprice", "rate", "cost_per_unit", "item_price"),
    "quantity": ("quantity", "qty", "units_sold", "units", "item_count", "pieces", "count"),
    "date": ("order_date", "transaction_date", "invoice_date", "sale_date", "date", "created_at", "timestamp"),
    "category": ("category", "product_category", "dept", "department", "genre", "item_group", "type"),
    "product": ("product", "product_name", "item", "item_name", "sku", "product_title", "description"),
    "region": ("region", "territory", "zone", "area", "market", "country", "state", "city", "location"),
    "customer": ("customer_name", "customer", "client_name", "client", "buyer", "user_name"),
    "email": ("customer_email", "email", "contact_email", "user_email", "e_mail"),
    "payment": ("payment_method", "payment_type", "payment", "mode_of_payment", "pay_method"),
    "status": ("order_status", "status", "delivery_status", "fulfillment_status", "state"),
}


@dataclass(frozen=True)
class SemanticMapping:
    """Role to column name; ``None`` where no column plays the role."""

    sales: str | None = None
    price: str | None = None
    quantity: str | None = None
    date: str | None = None
    category: str | None = None
    product: str | None = None
    region: str | None = None
    customer: str | None = None
    email: str | None = None
    payment: str | None = None
    status: str | None = None

    @property
    def money_columns(self) -> tuple[str, ...]:
        """Columns in which a negative value is a defect."""
        return tuple(c for c in (self.quantity, self.price, self.sales) if c is not None)

    @property
    def is_sales_dataset(self) -> bool:
        return bool(self.money_columns) and any((self.category, self.product, self.date))

    def items(self) -> list[tuple[str, str | None]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]


def normalize_name(header: str) -> str:
    """``" Order Date! "`` becomes ``order_date``."""
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", str(header).strip().lower()))


def _best_column(keywords: tuple[str, ...], free: Mapping[str, str]) -> str | None:
    """An exact keyword beats any partial one; earlier keywords beat later ones."""
    exact = (free[k] for k in keywords if k in free)
    partial = (header for k in keywords for name, header in free.items() if k in name or name in k)
    return next(exact, None) or next(partial, None)


def detect_semantics(columns: Iterable[str], overrides: Mapping[str, str | None] | None = None) -> SemanticMapping:
    """Settle the roles one after the other, each column used at most once.

    ``overrides`` pins a role to a column, or to ``None`` to say that no column plays it.
    """
    overrides = dict(overrides or {})
    unknown = set(overrides) - set(ROLE_KEYWORDS)
    if unknown:
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    by_name = {normalize_name(c): c for c in columns}
    chosen: dict[str, str | None] = dict(overrides)
    for role, keywords in ROLE_KEYWORDS.items():
        if role in overrides:
            continue
        taken = {c for c in chosen.values() if c is not None}
        free = {name: header for name, header in by_name.items() if header not in taken}
        chosen[role] = _best_column(keywords, free)
    return SemanticMapping(**chosen)


def looks_like_date(column: str, roles: SemanticMapping) -> bool:
    lowered = column.lower()
    return column == roles.date or "date" in lowered or "time" in lowered


def looks_like_email(column: str, roles: SemanticMapping) -> bool:
    return column == roles.email or "email" in column.lower()
