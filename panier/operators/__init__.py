"""Operators over the relations basket_item(basket_id, item, n) and basket_label(basket_id, label)."""
