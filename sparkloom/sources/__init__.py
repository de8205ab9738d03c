"""Tables of the model: schemas, readers, a file store, and export documents."""
