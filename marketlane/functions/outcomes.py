"""Outcome labels of keyed changes and of checkout (fixed values of the reference)."""

# Change outcomes.
OK = "OK"
CONFLICT = "CONFLICT"
DOES_NOT_EXIST = "DOES_NOT_EXIST"
FOREIGN_KEY_VIOLATION = "FOREIGN_KEY_VIOLATION"

# Checkout statuses (plus the code check that runs before it).
BASKET_INVALID = "BASKET_INVALID"
SHIPPING_ADDRESS_INVALID = "SHIPPING_ADDRESS_INVALID"
DISCOUNT_CODE_NOT_EXIST = "DISCOUNT_CODE_NOT_EXIST"
