"""Named queries over the tables of a folder, with SQL for those that SQL can express."""
