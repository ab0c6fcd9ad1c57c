"""Analytics over knowledge vaults (documents, chunks, vectors, layout, chats, graphs, jobs) as Spark DataFrames."""
