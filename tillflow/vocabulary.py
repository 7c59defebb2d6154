"""Names, codes and texts of the message protocol.

Everything in this file is a fixed value: it must be spelled exactly like
this for messages to be understood and for results to be equal.
"""

# -- services and topics ------------------------------------------------------

USER, ORDER, STOCK, PAYMENT, WEB = "user", "order", "stock", "payment", "web"

IN_TOPIC = {USER: "user_in", ORDER: "order_in", STOCK: "stock_in", PAYMENT: "payment_in"}
DEFAULT_OUT_TOPIC = "user_out_api1"
RESPONSE_TOPICS = ["user_out_api1", "orders_out_api1", "stock_out_api1", "payment_out_api1"]

# -- routes: (route, service, names of the path parameters) --------------------

ROUTES = [
    ("users/create", USER, []),
    ("users/remove", USER, ["user_id"]),
    ("users/find", USER, ["user_id"]),
    ("users/credit", USER, ["user_id"]),
    ("users/credit/subtract", USER, ["user_id", "amount"]),
    ("users/credit/add", USER, ["user_id", "amount"]),
    ("orders/create", ORDER, ["user_id"]),
    ("orders/remove", ORDER, ["order_id"]),
    ("orders/find", ORDER, ["order_id"]),
    ("orders/addItem", ORDER, ["order_id", "item_id"]),
    ("orders/removeItem", ORDER, ["order_id", "item_id"]),
    ("orders/checkout", ORDER, ["order_id"]),
    ("stock/availability", STOCK, ["item_id"]),
    ("stock/subtract", STOCK, ["item_id", "amount"]),
    ("stock/add", STOCK, ["item_id", "amount"]),
    ("stock/item/create", STOCK, []),
    ("payment/pay", PAYMENT, ["order_id"]),
    ("payment/cancelPayment", PAYMENT, ["order_id"]),
    ("payment/status", PAYMENT, ["order_id"]),
]

# the param that keys each service's state
KEY_PARAM = {USER: "user_id", ORDER: "order_id", STOCK: "item_id", PAYMENT: "order_id"}

BATCH_PREFIX = "batch:"

# -- codes ---------------------------------------------------------------------

OPERATION_RESULT = {0: "SUCCESS", 1: "FAILURE", 2: "ERROR"}
SUCCESS, FAILURE, ERROR = 0, 1, 2

CHECKOUT_STATUS = {0: "NOT_PROCESSED", 1: "IN_PROGRESS", 2: "SUCCEEDED", 3: "FAILED", 4: "INVALID"}
NOT_PROCESSED, IN_PROGRESS, SUCCEEDED, FAILED, INVALID = 0, 1, 2, 3, 4

PAYMENT_STATUS = {0: "INVALID", 1: "PAID", 2: "FAILED", 3: "CANCELLED", 4: "PROCESSING"}

# checkout progress bits
AWAIT_STOCK = 1
AWAIT_PAYMENT = 2
AWAIT_RESTOCK = 4
AWAIT_REFUND = 8
STOCK_FAILED = 16
PAYMENT_FAILED = 32
STOCK_OK = 64
PAYMENT_OK = 128
RESTOCK_SENT = 256
REFUND_SENT = 512

# -- limits ----------------------------------------------------------------------

REQUEST_TIMEOUT_SECONDS = 60
CHECKOUT_TIMEOUT_MS = 10_000
BATCH_WINDOW_SECONDS = 10

# -- entity names in error texts ---------------------------------------------------

ENTITY = {USER: "user", ORDER: "order", STOCK: "stock_item", PAYMENT: "payment"}

MANAGED = "Managed Exception: "
UNMANAGED = "Unmanaged Exception: "
UNKNOWN_ROUTE = "Unrecognised route."
UNKNOWN_SENDER = "Unknown sender."
NO_STATE = "Unknown message state."


def not_found(entity: str) -> str:
    return f"Entry '{entity}' with the given ID does not exist."


def unknown_state(token: str | None) -> str:
    return "Unrecognised state: " + ("null." if token is None else f'"{token}".')


BAD_AMOUNT = "Amount must be positive."
NO_CREDITS = "Not enough credits."
NO_STOCK = "Not enough items in stock."
CANNOT_REMOVE = "Cannot remove order."
CANNOT_MODIFY = "Cannot modify order."
CHECKOUT_DONE = "Order successfully purchased."
CHECKOUT_FAILED = "Order checkout failed."
