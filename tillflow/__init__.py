"""tillflow: Spark operators for event-driven commerce data.

Commands about users, orders, stock and payments arrive as JSON messages; the
package turns them into ledgers, baskets, checkouts and correlated responses,
in batch and with Structured Streaming.
"""

from tillflow.session import prepare, shared_folder

__all__ = ["prepare", "shared_folder"]
