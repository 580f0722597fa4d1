"""postloom: search, analytics and corpus preparation for collections of messages, on Spark."""
