"""civiltext: abusive-language scoring and moderation analytics on Spark DataFrames."""
