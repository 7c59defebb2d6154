"""The fixture views as SQL, for the checking queries."""

VIEWS = {
    "cmd": """
        SELECT CAST(event_id AS VARCHAR) request_id, event_id seq, ts, epoch_us(ts) t,
               CAST(user_id AS VARCHAR) user_id, CAST(round(value * 100) AS BIGINT) amount,
               CASE event_type WHEN 'signup' THEN 'users/credit/add' WHEN 'purchase' THEN 'users/credit/subtract'
                    WHEN 'view' THEN 'users/find' WHEN 'click' THEN 'users/credit'
                    WHEN 'error' THEN 'users/unknown' END route
        FROM events""",
    "users0": """
        SELECT CAST(c_custkey AS VARCHAR) user_id,
               greatest(0, CAST(floor(c_acctbal / 5) AS BIGINT)) credits, c_acctbal >= 0 user_exists
        FROM customer""",
    "items0": """
        SELECT CAST(p_partkey AS VARCHAR) item_id, CAST(p_size AS BIGINT) * 20 amount, p_size > 5 item_exists
        FROM part""",
    "orders0": """
        SELECT CAST(o_orderkey AS VARCHAR) order_id, o_orderkey seq, CAST(o_custkey AS VARCHAR) user_id,
               o_orderdate ts, epoch_us(o_orderdate) t, o_orderstatus = 'F' is_paid,
               CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 2 WHEN 'P' THEN 3 END checkout_status
        FROM orders""",
    "lines0": """
        SELECT CAST(l_orderkey AS VARCHAR) order_id, CAST(l_partkey AS VARCHAR) item_id,
               CAST(sum(l_quantity) AS BIGINT) qty
        FROM lineitem GROUP BY 1, 2""",
    "prices": """
        SELECT order_id, CAST(sum(qty) AS BIGINT) price, count(*) n_items FROM lines0 GROUP BY 1""",
    "req_params": """
        SELECT *, CASE WHEN route IN ('users/credit/add', 'users/credit/subtract')
                       THEN '{"user_id":"' || user_id || '","amount":"' || amount || '"}'
                       ELSE '{"user_id":"' || user_id || '"}' END params
        FROM cmd""",
    "msg_text": """
        SELECT *, '{"input":{"request_id":"' || request_id || '","consumer":"user_in","route":"' || route
                  || '","params":' || params || '},"params":' || params || ',"state":{"route":"' || route
                  || '","sender":"web","state":null}}' full_value
        FROM req_params""",
    "msg": """
        SELECT *, CASE WHEN route = 'users/unknown' THEN substr(full_value, 1, 20) ELSE full_value END value
        FROM msg_text""",
    # ordered guarded takes from stock, one recursion step per take of an item
    "item_cmd": """
        SELECT item_id, order_id, qty,
               row_number() OVER (PARTITION BY item_id ORDER BY ts, seq) rn
        FROM lines0 JOIN orders0 USING (order_id)""",
    "item_fold": """
        SELECT c.item_id, c.order_id, c.qty, c.rn, i.amount >= c.qty ok,
               CASE WHEN i.amount >= c.qty THEN i.amount - c.qty ELSE i.amount END bal
        FROM item_cmd c JOIN items0 i USING (item_id) WHERE c.rn = 1
        UNION ALL
        SELECT c.item_id, c.order_id, c.qty, c.rn, f.bal >= c.qty,
               CASE WHEN f.bal >= c.qty THEN f.bal - c.qty ELSE f.bal END
        FROM item_fold f JOIN item_cmd c ON c.item_id = f.item_id AND c.rn = f.rn + 1""",
    "user_cmd": """
        SELECT user_id, order_id, price, n_items,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) rn
        FROM prices JOIN orders0 USING (order_id)""",
    "user_fold": """
        SELECT c.user_id, c.order_id, c.price, c.n_items, c.rn, u.credits >= c.price ok,
               CASE WHEN u.credits >= c.price THEN u.credits - c.price ELSE u.credits END bal
        FROM user_cmd c JOIN users0 u USING (user_id) WHERE c.rn = 1
        UNION ALL
        SELECT c.user_id, c.order_id, c.price, c.n_items, c.rn, f.bal >= c.price,
               CASE WHEN f.bal >= c.price THEN f.bal - c.price ELSE f.bal END
        FROM user_fold f JOIN user_cmd c ON c.user_id = f.user_id AND c.rn = f.rn + 1""",
    "taken": """
        SELECT order_id, bool_and(ok) stock_ok, count(*) FILTER (NOT ok) failed_items,
               CAST(coalesce(sum(qty) FILTER (ok), 0) AS BIGINT) taken_qty
        FROM item_fold GROUP BY 1""",
    "saga": """
        SELECT order_id, user_id, price, n_items, stock_ok, ok payment_ok, failed_items,
               CAST(CASE WHEN stock_ok AND ok THEN 2 ELSE 3 END AS BIGINT) checkout_status,
               stock_ok AND ok is_paid,
               CASE WHEN stock_ok AND ok THEN 0 ELSE taken_qty END restock_qty,
               CASE WHEN ok AND NOT stock_ok THEN price ELSE 0 END refund
        FROM user_fold JOIN taken USING (order_id)""",
    "ledger_cmd": """
        SELECT user_id, seq, t, amount, CASE WHEN route = 'users/credit/add' THEN amount ELSE -amount END delta,
               row_number() OVER (PARTITION BY user_id ORDER BY t, seq) rn
        FROM cmd WHERE route IN ('users/credit/add', 'users/credit/subtract') AND amount > 0""",
    "ledger": """
        SELECT user_id, seq, delta, rn, delta >= 0 ok, greatest(delta, 0) bal FROM ledger_cmd WHERE rn = 1
        UNION ALL
        SELECT c.user_id, c.seq, c.delta, c.rn, f.bal + c.delta >= 0,
               CASE WHEN f.bal + c.delta >= 0 THEN f.bal + c.delta ELSE f.bal END
        FROM ledger f JOIN ledger_cmd c ON c.user_id = f.user_id AND c.rn = f.rn + 1""",
}

NEEDS = {
    "prices": ["lines0"],
    "req_params": ["cmd"], "msg_text": ["req_params"], "msg": ["msg_text"],
    "item_cmd": ["lines0", "orders0"], "item_fold": ["item_cmd", "items0"],
    "user_cmd": ["prices", "orders0"], "user_fold": ["user_cmd", "users0"],
    "taken": ["item_fold"], "saga": ["user_fold", "taken"],
    "ledger_cmd": ["cmd"], "ledger": ["ledger_cmd"],
}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` behind the views it names and those they need; ``more`` adds its own."""
    order: list[str] = []

    def add(name):
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
