from shopfloor.functions.columns import (
    ack_label,
    format_employee,
    format_part,
    identity_text,
    is_open_closed_date,
    month_name,
    on_hold_label,
    signed_price,
    status_name,
    unit_cost,
)
from shopfloor.functions.text import (
    mmdd,
    parse_int_list,
    render_stage,
    trimmed_items,
)

__all__ = [
    "ack_label",
    "format_employee",
    "format_part",
    "identity_text",
    "is_open_closed_date",
    "mmdd",
    "month_name",
    "on_hold_label",
    "parse_int_list",
    "render_stage",
    "signed_price",
    "status_name",
    "trimmed_items",
    "unit_cost",
]
