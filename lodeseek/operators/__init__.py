"""Search, chunking, embedding and index operators over DataFrames."""
