"""End-to-end plans: check, context, review and the registered queries."""
