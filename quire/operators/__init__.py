"""DataFrame operators; doc_id leads every key."""
